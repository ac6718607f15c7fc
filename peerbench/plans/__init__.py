from peerbench.plans.people import answers, clean, derive, distributions, enrich, impute, prepare, profile, run, segment

__all__ = ["answers", "clean", "derive", "distributions", "enrich", "impute", "prepare", "profile", "run", "segment"]
