"""Deterministic cohorts: splits, samples, folds, assignments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsemark.functions import hashing as H
from pulsemark.functions.dims import with_totals
from pulsemark.functions.ordered import first_rows, with_position
from pulsemark.session import BROADCAST_ROWS, settle


def split_groups(df: DataFrame, group: str, fraction: float, seed: str) -> DataFrame:
    """(group, partition): the first ceil(fraction*n) groups in hash order validate; at least 2 on each side.

    Fewer than 4 groups are an error when the result is read.
    """
    groups = df.select(group).distinct().withColumn("_h", H.digest(seed, F.col(group)))
    placed = with_totals(with_position(groups, [], ["_h", group], "_pos"), _n=F.count(F.lit(1)))
    placed = placed.withColumn("_n", F.when(F.col("_n") >= 4, F.col("_n")).otherwise(F.raise_error(F.lit("fewer than 4 groups to split"))))
    cut = F.least(F.greatest(F.lit(2), F.ceil(F.round(F.col("_n") * F.lit(fraction), 9))), F.col("_n") - 2)
    return placed.select(group, F.when(F.col("_pos") < cut, "validation").otherwise("development").alias("partition"))


def _enough(counts: DataFrame, wanted: int, what: str) -> None:
    """Raise when a count ``_n`` is below ``wanted``; one count job, and the shortest entry reaches the driver."""
    least = counts.agg(F.min("_n")).first()[0]
    if least is not None and least < wanted:
        raise ValueError(f"a {what} has {least} of {wanted} rows")


def diverse_sample(df: DataFrame, category: str, group: str, unit: str, k: int, seed: str) -> DataFrame:
    """k rows per category, one per group first, then topped up in hash order; raises when a category is short."""
    _enough(df.groupBy(category).agg(F.count(F.lit(1)).alias("_n")), k, "category")
    drawn = df.withColumn("_h", H.digest(seed, F.col(unit)))
    depth = with_position(drawn, [category, group], ["_h", unit], "_depth")
    later = depth.withColumn("_later", (F.col("_depth") > 0).cast("int"))
    return first_rows(later, [category], ["_later", "_h", unit], k).drop("_h", "_depth", "_later")


def round_robin(df: DataFrame, group: str, unit: str, n: int, seed: str) -> DataFrame:
    """n rows taken one per group in group order, then the second of each, and so on; raises when there are fewer."""
    _enough(df.agg(F.count(F.lit(1)).alias("_n")), n, "table")
    drawn = df.withColumn("_h", H.digest(seed, F.col(unit)))
    depth = with_position(drawn, [group], ["_h", unit], "_depth")
    return depth.orderBy("_depth", group).limit(n).drop("_h", "_depth")


def per_bin_sample(df: DataFrame, bin_column: str, unit: str, k: int, seed: str) -> DataFrame:
    drawn = df.withColumn("_h", H.digest(seed, F.col(unit)))
    return first_rows(drawn, [bin_column], ["_h", unit], k).drop("_h")


def unique_user_corpus(
    index: DataFrame, group: str, user: str, unit: str, per_group: int, calibration: int, groups: int, seed: str
) -> DataFrame:
    """``per_group`` units of distinct users from ``groups`` groups, each user used once overall.

    Groups are visited in hash order; one without enough unused users is passed over; raises when groups run short.
    The first ``calibration`` of a group are marked as such.

    The rule is sequential, so groups are settled in batches of hash ranks (the missing number of groups, doubled), and
    inside a batch by reservations (``_claimed``), many groups a pass. Used users are a table joined by anti-join; counts
    alone reach the driver.
    """
    one = first_rows(index.withColumn("_h", H.digest(seed, F.col(group), F.col(unit))), [group, user], ["_h", unit], 1)
    one = settle(one.select(group, user, unit, "_h"))
    large = one.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= per_group)
    order = settle(with_position(large.withColumn("_g", H.digest(seed, F.col(group))), [], ["_g", group], "_rank").select(group, "_rank"))
    n_groups, taken, start = order.count(), 0, 0
    chosen = None
    while taken < groups and start < n_groups:
        stop = start + 2 * (groups - taken)
        ranks, used = stop - start, taken * per_group  # rows of the batch's ranks and of the users taken
        batch = order.where((F.col("_rank") >= start) & (F.col("_rank") < stop))
        here = one.join(F.broadcast(batch) if ranks <= BROADCAST_ROWS else batch, group)
        if chosen is not None:
            out = chosen.select(user)
            here = here.join(F.broadcast(out) if used <= BROADCAST_ROWS else out, user, "left_anti")
        batch = _claimed(settle(here), user, unit, per_group)
        if batch is None:
            start = stop
            continue
        first = with_position(batch.select("_rank").distinct(), [], ["_rank"], "_place").where(F.col("_place") < groups - taken)
        got = settle(batch.join(first.select("_rank"), "_rank"))
        taken += got.select("_rank").distinct().count()
        chosen = got if chosen is None else settle(chosen.unionByName(got))
        start = stop
    if taken < groups:
        raise ValueError(f"{taken} of {groups} groups have {per_group} unused users")
    role = F.when(F.col("_pos") < calibration, "calibration").otherwise("primary")
    return chosen.select(group, user, unit, role.alias("role"))


NARROWINGS = 3  # times that claims are narrowed in one pass


def _claimed(rows: DataFrame, user: str, unit: str, per_group: int) -> DataFrame | None:
    """Rows (_rank, user, unit, _h) that the groups of a batch get, in rank order, with their place ``_pos``; None if none.

    A group's claim is every user it may yet take: its list in hash order up to the ``per_group``-th user that no
    undecided group of a lower rank claims, for those are its own whatever the others do. Claims begin as whole lists and
    are narrowed from each other. A group whose claim holds no other users is settled, a group with too few users left is
    out, and users of settled groups leave all lists. The lowest undecided group settles in every pass, and so does every
    group that no chain of claims ties to an undecided one.
    """
    settled = None
    while True:
        enough = rows.groupBy("_rank").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= per_group).select("_rank")
        rows = settle(rows.join(enough, "_rank"))
        if rows.isEmpty():
            return settled
        done = settle(_reserved(rows, user, unit, per_group))
        if done.isEmpty():
            raise RuntimeError("no group could be settled")
        settled = done if settled is None else settle(settled.unionByName(done))
        rows = rows.join(done.select("_rank").distinct(), "_rank", "left_anti").join(done.select(user), user, "left_anti")


def _reserved(rows: DataFrame, user: str, unit: str, per_group: int) -> DataFrame:
    """Rows of the groups that one pass settles, with their place ``_pos``."""
    order = ["_h", unit, user]  # a unit may have several users: the user settles ties
    at = F.struct(*order)
    claims = rows
    for _ in range(NARROWINGS):
        owner = claims.groupBy(user).agg(F.min("_rank").alias("_owner"))  # combined before the shuffle, however wanted a user is
        own = claims.join(owner, user).where(F.col("_rank") <= F.col("_owner")).drop("_owner")
        sure = first_rows(own, ["_rank"], order, per_group)
        edge = sure.groupBy("_rank").agg(F.count(F.lit(1)).alias("_sure"), F.max(at).alias("_edge"))
        claims = claims.join(edge, "_rank", "left").where(F.coalesce(F.col("_sure") < per_group, F.lit(True)) | (at <= F.col("_edge")))
        claims = settle(claims.withColumn("_full", F.coalesce(F.col("_sure") == per_group, F.lit(False))).select(*rows.columns, "_full"))
    size = claims.groupBy("_rank").agg(F.count(F.lit(1)).alias("_n"), F.bool_and("_full").alias("_all"))
    good = size.where(F.col("_all") & (F.col("_n") == per_group)).select("_rank")
    settled = claims.join(good, "_rank").select(*rows.columns)  # per_group rows each
    return settled.withColumn("_pos", F.row_number().over(Window.partitionBy("_rank").orderBy(*order)) - 1)


def ordered_subset(df: DataFrame, wanted: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``wanted`` keys in its own order; ``order`` comes from ``wanted``."""
    return df.join(wanted.select(key, order), key)


def group_folds(df: DataFrame, group: str, k: int, seed: str) -> DataFrame:
    """(group, fold): groups dealt to k folds, larger groups first, hash order inside a size."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    keyed = sizes.withColumn("_minus", -F.col("rows")).withColumn("_h", H.digest(seed, F.col(group)))
    placed = with_position(keyed, [], ["_minus", "_h", group], "_pos")
    return placed.select(group, "rows", (F.col("_pos") % k).alias("fold"))


def shuffled_values(df: DataFrame, unit: str, value: str, seed: str) -> DataFrame:
    """The same values dealt to the units in another order (frequencies kept)."""
    left = with_position(df.select(unit), [], [unit], "_pos")
    right = with_position(df.select(F.col(unit).alias("_u"), value).withColumn("_h", H.digest(seed, F.col("_u"))), [], ["_h", "_u"], "_pos")
    return left.join(right.select("_pos", value), "_pos").drop("_pos")


def duplicate_payloads(df: DataFrame, unit: str, family: str, payload: str) -> DataFrame:
    """Family pairs of a unit with equal payloads.

    Families are a short fixed list, so a payload held by m families of one unit gives
    m(m-1)/2 rows with m at most the number of families; units are not paired.
    """
    held = df.groupBy(unit, payload).agg(F.sort_array(F.collect_set(family)).alias("_f")).where(F.size("_f") > 1)
    pairs = F.flatten(
        F.transform("_f", lambda a, i: F.transform(F.filter("_f", lambda b: b > a), lambda b: F.struct(a.alias("family_a"), b.alias("family_b"))))
    )
    return held.select(unit, payload, F.explode(pairs).alias("_pair")).select(unit, payload, "_pair.*")


def stack_sources(frames: dict[str, DataFrame], id_columns: Sequence[str]) -> DataFrame:
    """Union by name (missing columns NULL) with the source and a stable row id."""
    out = None
    for name, df in frames.items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out.withColumn("row_id", H.short_id(F.col("source"), *[F.col(c) for c in id_columns]))


def set_digest(df: DataFrame, column: str) -> DataFrame:
    """Order-free digest of a distinct id set: the count and the sums of four slices of every id's SHA-256, hashed.

    Sums combine map-side, so no task ever holds the set.
    """
    ids = df.select(F.col(column).cast("string").alias("_id")).where(F.col("_id").isNotNull()).distinct()
    slices = [F.conv(F.substring(F.sha2("_id", 256), 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = ids.agg(F.count(F.lit(1)).alias("ids"), *[F.sum(s).alias(f"_s{i}") for i, s in enumerate(slices)])
    return sums.select("ids", H.digest(F.col("ids"), *[F.col(f"_s{i}") for i in range(4)]).alias("digest"))


def quartile_policy(df: DataFrame, value: str) -> DataFrame:
    """The quartiles of a cohort, from which candidate policies are defined."""
    from pulsemark.functions.ranks import exact_quantiles

    return exact_quantiles(df, [], value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def rule_grid(words: DataFrame, thresholds: Sequence[tuple[str, float]], reason: str = "reason") -> DataFrame:
    """Words multiplied by the candidate rules (a short literal list) with each rule's reason."""
    from pulsemark.operators import coding as C

    entries = [
        F.struct(F.lit("R1").alias("rule_id"), C.integrity_reason("baseline", F.col("word"), F.col("weights")).alias(reason)),
        *[
            F.struct(F.lit(f"R2_{n}").alias("rule_id"), C.integrity_reason("low_bits", F.col("word"), F.col("weights"), t).alias(reason))
            for n, t in thresholds
        ],
        F.struct(F.lit("R4").alias("rule_id"), C.integrity_reason("not_minimum", F.col("word"), F.col("weights")).alias(reason)),
    ]
    return words.withColumn("_rule", F.explode(F.array(*entries))).select("*", "_rule.rule_id", f"_rule.{reason}").drop("_rule")

