"""Column-level building blocks (all JVM-side built-in expressions)."""

from flowscore.functions.cleaning import (  # noqa: F401
    binarize_label,
    clean_inf,
    encode_categorical,
    fill_missing,
    numeric_label,
    standard_scale,
    to_feature,
)
from flowscore.functions.routing import flow_to_mode, select_mode  # noqa: F401
from flowscore.functions.voting import (  # noqa: F401
    any_vote,
    hard_vote,
    mean_of,
    member_vote,
    std_pop_of,
    three_label,
    vote_threshold,
    weighted_vote,
)
