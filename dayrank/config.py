"""Parameters of a run."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class FeatureConfig:
    """What to compute, and the sizes that decide how joins are laid out.

    ``last_label_day`` is the newest day with known purchases and the day that is scored.
    ``gap_days`` are removed from the log and never used as label or sample day.
    """

    last_label_day: date = date(2014, 12, 18)
    gap_days: tuple[date, ...] = (date(2014, 12, 11), date(2014, 12, 12))
    n_label_days: int = 15
    #: Length of the look-back in days, and the divisor of the daily average.
    slot: int = 10
    sub_windows: tuple[int, ...] = (5, 3, 7)
    #: Sub-windows grow by the gap's length when the day this far back is a gap day.
    widen_probe: int = 5
    #: Only touches of these behaviours make a sample; None takes all.
    sample_behaviours: tuple[int, ...] | None = None
    #: Append the extra families to the features. They need the sub-windows 5 and 3.
    extras: bool = False
    negatives_per_positive: int = 90
    #: Which negatives a training set takes: "exact", the first by a seeded hash up to the count, or
    #: "bernoulli", each with the same chance, in one pass, with weights.
    sampling: str = "exact"
    #: Count an item's users by sketches that are merged by window, instead of exactly.
    approximate_users: bool = False
    #: Size of such a sketch: 12 gives a relative standard error of 1.6 %.
    sketch_lg_k: int = 12
    top_k: int = 700
    seed: int = 10
    #: Each round costs a pass over the training set, see README.
    boosting_rounds: int = 900
    #: A join key is hot, and spread over several tasks, when it has more rows than this and more
    #: than its share: the rows by ``hot_share`` x shuffle partitions. So at most that many keys
    #: are hot, and none that matters is left out: any other is a fraction of a mean task.
    hot_rows: int = 1_000_000
    hot_share: int = 4
    #: A table is broadcast only when its counted rows times its columns do not exceed this.
    broadcast_values: int = 5_000_000
