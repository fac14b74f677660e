"""Fixed schemas, the five entities, and the names of the feature columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

BEHAVIOURS = (1, 2, 3, 4)
PURCHASE = 4
HOURS = tuple(range(24))
#: Ratio name -> behaviour counted per purchase.
RATIOS = {"click": 1, "skim": 2, "collect": 3}
SAMPLE_KEY = ("label_day", "user_id", "item_id")
#: Rows without ids are no touches of a pair.
WITH_IDS = "user_id IS NOT NULL AND item_id IS NOT NULL"

RAW_LOG = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("behavior_type", T.IntegerType()),
    T.StructField("item_category", T.LongType()),
    T.StructField("time", T.StringType()),
])
ITEMS = T.StructType([T.StructField("item_id", T.LongType())])
PREPARED_LOG = T.StructType(
    RAW_LOG.fields
    + [T.StructField("hour", T.IntegerType()), T.StructField("day", T.DateType())]
)
SUBMISSION = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
])


@dataclass(frozen=True)
class Entity:
    """A feature block: its key, its column prefix and the families it carries."""

    name: str
    prefix: str
    keys: tuple[str, ...]
    rates: bool = False
    unique_users: bool = False
    hours: tuple[str, ...] = ()
    type_max: bool = False
    profile: str | None = None
    live: str | None = None


USER = Entity("user", "u", ("user_id",), rates=True, hours=("min", "max", "range"),
              profile="uh", live="ulive")
ITEM = Entity("item", "i", ("item_id",), rates=True, unique_users=True)
CATEGORY = Entity("category", "c", ("item_category",), rates=True)
USER_CATEGORY = Entity("user_category", "uc", ("user_id", "item_category"),
                       hours=("min", "max"), type_max=True, profile="uch")
USER_ITEM = Entity("user_item", "ui", ("user_id", "item_id"),
                   hours=("min", "max"), type_max=True, profile="uih")
ENTITIES = (USER, ITEM, CATEGORY, USER_CATEGORY, USER_ITEM)


def behaviour_columns(stem: str) -> list[str]:
    return [f"{stem}_b{b}" for b in BEHAVIOURS]


def ratio_columns(stem: str) -> list[str]:
    return [f"{stem}_{name}" for name in RATIOS]


def profile_columns(stem: str) -> list[str]:
    return [f"{stem}_h{h:02d}_b{b}" for h in HOURS for b in BEHAVIOURS]


def narrow_columns(entity: Entity, sub_windows: tuple[int, ...]) -> list[str]:
    """The entity's features without its hour profile and active days."""
    p = entity.prefix
    names = behaviour_columns(f"{p}_long") + behaviour_columns(f"{p}_d1")
    if entity.rates:
        names += behaviour_columns(f"{p}_avg") + ratio_columns(f"{p}_ratio")
    if entity.unique_users:
        names += behaviour_columns(f"{p}_uniq")
    sub = [c for n in sub_windows for c in behaviour_columns(f"{p}_d{n}")]
    day_end = [f"{p}_hour_{h}" for h in entity.hours] + [f"{p}_type_max"] * entity.type_max
    # The user block keeps its hours after the sub-windows, the pair blocks before them.
    return names + (sub + day_end if entity.rates else day_end + sub)


def block_columns(entity: Entity, sub_windows: tuple[int, ...]) -> list[str]:
    """All features of the entity, wide families last."""
    return (
        narrow_columns(entity, sub_windows)
        + (profile_columns(entity.profile) if entity.profile else [])
        + (behaviour_columns(f"{entity.live}_days") if entity.live else [])
    )


#: Extra families: ratios over sub-windows, days between first and last touch, hour profiles of a
#: user over several days.
RATIO_WINDOWS = (5, 3)
SPAN_ENTITIES = (USER_ITEM, USER_CATEGORY)
PROFILE_DAYS = (2, 5)


def extra_columns() -> list[str]:
    names = [
        c
        for e in (USER, ITEM, CATEGORY)
        for n in RATIO_WINDOWS
        for c in ratio_columns(f"{e.prefix}_d{n}_ratio")
    ]
    names += [f"{e.prefix}_span" for e in SPAN_ENTITIES]
    return names + [c for n in PROFILE_DAYS for c in profile_columns(f"{USER.profile}{n}d")]


def feature_columns(
    sub_windows: tuple[int, ...] = (5, 3, 7), extras: bool = False
) -> list[str]:
    """The full feature list in its fixed order, the same for training and scoring; the extra
    families come last."""
    names = [c for e in ENTITIES for c in narrow_columns(e, sub_windows)]
    for entity in (USER, USER_ITEM, USER_CATEGORY):
        names += profile_columns(entity.profile)
    names += behaviour_columns(f"{USER.live}_days")
    return names + (extra_columns() if extras else [])


def double_columns() -> set[str]:
    """Features that are averages or ratios; all others are counts or codes."""
    return {
        c
        for e in ENTITIES
        if e.rates
        for c in behaviour_columns(f"{e.prefix}_avg")
        + ratio_columns(f"{e.prefix}_ratio")
        + [r for n in RATIO_WINDOWS for r in ratio_columns(f"{e.prefix}_d{n}_ratio")]
    }


def features_schema(
    with_label: bool, sub_windows: tuple[int, ...] = (5, 3, 7), extras: bool = False
) -> T.StructType:
    doubles = double_columns()
    hours = {f"{e.prefix}_hour_{h}" for e in ENTITIES for h in e.hours}
    codes = {f"{e.prefix}_type_max" for e in ENTITIES if e.type_max}
    codes |= {f"{e.prefix}_span" for e in SPAN_ENTITIES}

    def kind(name: str) -> T.DataType:
        if name in doubles:
            return T.DoubleType()
        return T.IntegerType() if name in hours | codes else T.LongType()

    fields = [
        T.StructField("label_day", T.DateType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("item_category", T.LongType()),
    ]
    if with_label:
        fields.append(T.StructField("label", T.IntegerType()))
    return T.StructType(
        fields + [T.StructField(c, kind(c)) for c in feature_columns(sub_windows, extras)]
    )
