from peerbench.functions.flags import default_label, peer_flag
from peerbench.functions.numbers import clamp, log10, round_int, round_places, to_number, to_pay, years_since
from peerbench.functions.text import clean_text, empty_to

__all__ = [
    "clamp", "clean_text", "default_label", "empty_to", "log10", "peer_flag",
    "round_int", "round_places", "to_number", "to_pay", "years_since",
]
