from peerbench.sources.people import (
    add_row_id, drop_index, infer_types, null_tokens, read_people, round_floats, spread, write_people,
)

__all__ = [
    "add_row_id", "drop_index", "infer_types", "null_tokens", "read_people", "round_floats", "spread", "write_people",
]
