"""Splits by whole groups: contiguous ranges of hash-ordered groups, feasibility, overlap between parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import filled, hash_bucket
from ..sources.shared import stored
from .frames import global_rank, next_at_or_after, running_by_value
from .graph import components, with_group, with_match

HARD_KEYS = ["exact_key", "near_key"]
#: Tiers of entity keys beside the hard keys, the coarsest first.
TIERS = {
    "ENTITY_ALL_ENDPOINTS": ["entity_source", "entity_destination", "entity_host"],
    "ENTITY_SOURCE_HOST": ["entity_source", "entity_host"],
    "HARD_GROUP_ONLY": [],
}
PARTS = {"TRAIN": 0.7, "VALIDATION": 0.15, "TEST": 0.15}


def group_roots(rows: DataFrame, row: str, sets: dict[str, list[str]]) -> DataFrame:
    """name, row, root: for every set of keys, each row and the smallest row that it reaches over equal keys of the set.

    Blank keys link nothing; keys are told apart by name, so that equal texts of two keys do not meet. Texts are read and
    hashed once for all sets, and only hashes that more than one row has count. A hash stands for its smallest row, the
    hub; a row holds to its smallest hub of the set, and its other hubs give an edge to that one. So the graphs, which are
    settled together, have hubs for nodes and different pairs of them for edges, however many rows agree.
    """
    keys = list(dict.fromkeys(k for s in sets.values() for k in s))
    cells = [F.struct(F.lit(i).alias("i"), F.when(filled(k), F.unhex(F.sha2(F.concat(F.lit(f"{k}:"), F.col(k)), 256))).alias("k")) for i, k in enumerate(keys)]
    long = stored(rows.filter(F.col(row).isNotNull()).select(F.col(row).alias("a"), F.explode(F.array(*cells)).alias("c")).select("a", "c.*").filter("k is not null"))
    hubs = with_group(long, "k", "a", {"_b": F.min("a"), "_t": F.max("a")}, {"b": F.min("_b"), "t": F.max("_t")}).filter("b < t")
    # A row has few hubs: one a key.
    own = Window.partitionBy("a")
    may = [F.col("i").isin([keys.index(k) for k in s]) for s in sets.values()]
    hubs = stored(hubs.select("a", "i", "b", *[F.min(F.when(e, F.col("b"))).over(own).alias(f"_m{j}") for j, e in enumerate(may)]))
    in_sets = lambda m: F.explode(F.array(*[F.struct(F.lit(j).alias("s"), m(j).alias("m")) for j in range(len(sets))])).alias("x")
    edges = hubs.select("b", in_sets(lambda j: F.when(may[j], F.col(f"_m{j}")))).select("x.s", F.col("b").alias("a"), F.col("x.m").alias("b")).filter("a <> b")
    roots = components(edges, within=("s",)).withColumnRenamed("node", "m")
    least = hubs.groupBy("a").agg(*[F.min(f"_m{j}").alias(f"_m{j}") for j in range(len(sets))])
    held = rows.select(row).join(least, F.col(row) == F.col("a"), "left").select(row, in_sets(lambda j: F.coalesce(f"_m{j}", row))).select(row, "x.*")
    name = F.get(F.array(*[F.lit(n) for n in sets]), F.col("s"))
    return with_match(held, roots, ["s", "m"], row).select(name.alias("name"), row, F.coalesce("root", "m").alias("root"))


def tier_roots(rows: DataFrame, row: str) -> DataFrame:
    """tier, row, root: ``group_roots`` by hard keys and each tier's entity keys."""
    return group_roots(rows, row, {t: HARD_KEYS + more for t, more in TIERS.items()}).withColumnRenamed("name", "tier")


def tier_groups(rows: DataFrame, row: str, tier: str) -> DataFrame:
    """rows with ``root``, the smallest row of their group, by hard keys and the tier's entity keys."""
    g = group_roots(rows, row, {tier: HARD_KEYS + TIERS[tier]}).select(F.col(row).alias("node"), "root").filter("node is not null").distinct()
    return rows.join(g, F.col(row) == F.col("node"), "left").drop("node")


def allocate_groups(rows: DataFrame, group: str, stratum: str, shares: dict[str, float] = PARTS, off: float = 0.02, stratum_off: float = 0.05, rounds: int = 8) -> DataFrame:
    """group, size, main, part: whole groups dealt to parts so that rows and every stratum come near their shares.

    Groups of one main stratum and one size class lie in order of their hash and are cut at the shares of their running
    rows. Then at most ``rounds`` repairs move groups, the largest that fit first, from the part with too many rows to the one
    with too few: of all strata, and where the parts are near enough, of the stratum that is farthest off. A repair
    is a range of a running sum; what comes to the driver is one number a stratum and part.
    """
    vectors = stored(rows.groupBy(group, stratum).agg(F.count("*").alias("n")))
    per = vectors.groupBy(group).agg(F.sum("n").alias("size"), F.max_by(stratum, F.struct("n", stratum)).alias("main"))
    per = per.withColumn("_c", F.floor(F.log2("size"))).withColumn("_h", F.sha2(F.concat(F.lit("part:"), F.col(group).cast("string")), 256))
    per = stored(per.withColumn("_k", F.struct("main", "_c", "_h")))
    run = stored(per.join(running_by_value(per, "_k", {"_s": F.col("size")}).select("_k", "cum__s"), "_k"))
    base = run.groupBy("main", "_c").agg(F.min(F.col("cum__s") - F.col("size")).alias("_b"), F.sum("size").alias("_n"))  # strata times size classes
    place = (F.col("cum__s") - F.col("_b") - F.col("size") / 2) / F.col("_n")
    names = list(shares)
    part = F.lit(names[-1])
    for p in reversed(names[:-1]):
        part = F.when(place < sum(shares[q] for q in names[: names.index(p) + 1]), p).otherwise(part)
    now = stored(run.join(F.broadcast(base), ["main", "_c"]).select(group, "size", "main", "_h", part.alias("part")))
    for _ in range(rounds):
        counts = {(r["s"], r["part"]): r["n"] for r in vectors.join(now.select(group, "part"), group).groupBy(F.col(stratum).alias("s"), "part").agg(F.sum("n").alias("n")).collect()}
        strata = sorted({s for s, _ in counts}, key=str)
        total = lambda s: sum(counts.get((s, p), 0) for p in shares)
        every = sum(total(s) for s in strata)
        too_many = {p: sum(counts.get((s, p), 0) for s in strata) - shares[p] * every for p in shares}
        of = None
        if every and max(abs(v) for v in too_many.values()) <= off * every:
            far = {s: {p: counts.get((s, p), 0) - shares[p] * total(s) for p in shares} for s in strata}
            of = max(strata, key=lambda s: max(abs(v) for v in far[s].values()) / total(s))
            too_many = far[of]
            if max(abs(v) for v in too_many.values()) <= stratum_off * total(of):
                break
        source, target = max(shares, key=lambda p: too_many[p]), min(shares, key=lambda p: too_many[p])
        need = int(min(too_many[source], -too_many[target]))
        may = now.filter((F.col("part") == source) & (F.col("size") <= need) & (F.lit(True) if of is None else F.col("main") == of)).withColumn("_o", F.struct((-F.col("size")).alias("o"), "_h"))
        moved = stored(running_by_value(may, "_o", {"_s": F.col("size")}).filter(F.col("cum__s") <= need).select(F.col("_o._h").alias("_h"), F.lit(target).alias("_to")))
        if not moved.limit(1).count():
            break
        now = stored(now.join(moved, "_h", "left").withColumn("part", F.coalesce("_to", "part")).drop("_to"))
    return now.select(group, "size", "main", "part")


def stratum_checks(df: DataFrame, stratum: str, part: str, shares: dict[str, float], off: float = 0.05) -> DataFrame:
    """check, actual, passed: the share of every part in the rows of every stratum."""
    wide = df.groupBy(stratum).agg(F.count("*").alias("all"), *[F.count_if(F.col(part) == p).alias(p) for p in shares])
    cells = [F.struct(F.concat(F.lit("STRATUM_"), F.col(stratum), F.lit(f"_{p}")).alias("check"), (F.col(p) / F.col("all")).alias("actual"), (F.abs(F.col(p) / F.col("all") - s) <= off).alias("passed")) for p, s in shares.items()]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def staged(rows: DataFrame, row: str, stratum: str, selected: str = "ENTITY_ALL_ENDPOINTS", approved: str | None = None, groups_least: int = 500, rows_least: int = 1500, off: float = 0.02, most: float = 0.1, stratum_off: float = 0.05) -> DataFrame:
    """tier, check, actual, passed, chosen: the split by whole groups of the selected tier, held against all criteria.

    Where it fails, the approved fallback is tried, and nothing else: without an approval, or where the fallback fails too, it is
    an error that names the failed criteria. Groups of hard keys alone are allocated by their strata; coarser tiers go by hash.
    """

    def evaluated(tier: str) -> tuple[DataFrame, list[str]]:
        g = stored(tier_groups(rows, row, tier).select("root", stratum))
        if tier == "HARD_GROUP_ONLY":
            g = stored(g.join(allocate_groups(g, "root", stratum, PARTS, off, stratum_off).select("root", "part"), "root"))
        else:
            b = F.pmod(F.xxhash64("root"), F.lit(10000))
            g = g.withColumn("part", F.when(b < 7000, "TRAIN").when(b < 8500, "VALIDATION").otherwise("TEST"))
        checks = feasibility(g, "root", "part", PARTS, groups_least, rows_least, off, most).unionByName(stratum_checks(g, stratum, "part", PARTS, stratum_off))
        checks = stored(checks.select(F.lit(tier).alias("tier"), "check", F.round("actual", 6).alias("actual"), F.coalesce("passed", F.lit(False)).alias("passed")))
        return checks, sorted(r["check"] for r in checks.filter("not passed").select("check").collect())  # a few criteria a stratum

    out, failed = evaluated(selected)
    if not failed:
        return out.withColumn("chosen", F.lit(True))
    if approved is None:
        raise ValueError(f"{selected} failed and no fallback is approved: {', '.join(failed)}")
    second, failed = evaluated(approved)
    if failed:
        raise ValueError(f"the approved fallback {approved} failed: {', '.join(failed)}")
    return out.withColumn("chosen", F.lit(False)).unionByName(second.withColumn("chosen", F.lit(True)))


def contiguous_split(groups: DataFrame, group: str, size: str, shares=(80, 10, 10), names=("TRAIN", "CALIBRATION", "COMPARISON")) -> DataFrame:
    """group, size, part: groups in order of their hash, cut where the running size is nearest to each share.

    Only the two cut places are sought, as the minima of the distance to the wanted running size; no pairs of
    boundaries are formed. Ties go to the earlier cut.
    """
    g = groups.select(group, size, F.sha2(F.concat(F.lit("split:"), F.col(group).cast("string")), 256).alias("_h"))
    run = stored(g.join(running_by_value(g, "_h", {"_s": F.col(size)}).select("_h", F.col("cum__s").alias("_cum")), "_h"))
    total = run.agg(F.sum(size).alias("_n"))
    first, second = shares[0], shares[0] + shares[1]
    far = lambda s: F.struct(F.abs(100 * F.col("_cum") - s * F.col("_n")), F.col("_cum"))
    cuts = run.crossJoin(F.broadcast(total)).agg(F.min(far(first))["_cum"].alias("_a"), F.min(far(second))["_cum"].alias("_b"))
    part = F.when(F.col("_cum") <= F.col("_a"), names[0]).when(F.col("_cum") <= F.col("_b"), names[1]).otherwise(names[2])
    return run.crossJoin(F.broadcast(cuts)).select(group, size, part.alias("part"))


def boundary_split(groups: DataFrame, group: str, size: str, shares=(80, 10, 10), names=("TRAIN", "CALIBRATION", "COMPARISON"), off: int = 2, least: int = 3072) -> DataFrame:
    """group, size, part: groups in order of their hash, cut at the best pair of boundaries.

    Every part's share lies within ``off`` points of the wanted one, the first part has ``least`` rows or more and none is empty.
    Of all such pairs the least (distances of the three parts from their shares, first boundary, second boundary) counts. The
    first boundary decides the first distance, so that it is sought by itself: a boundary is feasible where the next
    running size that leaves the second part large enough does not make it too large. An error where no pair is feasible.
    """
    g = groups.select(group, size, F.sha2(F.concat(F.lit("split:"), F.col(group).cast("string")), 256).alias("_h"))
    sums = running_by_value(g, "_h", {"_s": F.col(size), "_one": F.lit(1)}).select("_h", F.col("cum__s").alias("_cum"), F.col("cum__one").alias("_b"))
    run = stored(g.join(sums, "_h"))
    total = run.agg(F.sum(size).alias("_n"), F.count("*").alias("_k"))
    at = run.select("_cum", "_b").crossJoin(F.broadcast(total))
    near = lambda x, s: F.abs(100 * x - s * F.col("_n"))
    fits = lambda x, s: near(x, s) <= off * F.col("_n")
    first = at.filter(fits(F.col("_cum"), shares[0]) & (F.col("_cum") >= least) & (F.col("_b") < F.col("_k") - 1))
    second = at.filter(fits(F.col("_n") - F.col("_cum"), shares[2]) & (F.col("_b") < F.col("_k"))).select(F.col("_cum").alias("_c2"), F.col("_b").alias("_b2"))
    from_ = F.col("_cum") + F.ceil((shares[1] - off) * F.col("_n") / 100)
    after = stored(next_at_or_after(first.withColumn("_from", from_), "_from", second, "_c2", "_next"))
    open_ = after.filter(fits(F.col("_next") - F.col("_cum"), shares[1])).withColumn("_e", near(F.col("_cum"), shares[0]))
    # One or two boundaries have the least distance: one below the share and one above it.
    best = open_.join(F.broadcast(open_.agg(F.min("_e").alias("_e"))), "_e")
    pairs = second.crossJoin(F.broadcast(best)).filter(fits(F.col("_c2") - F.col("_cum"), shares[1]) & (F.col("_b2") > F.col("_b")))
    cuts = pairs.agg(F.min(F.struct(F.col("_e"), near(F.col("_c2") - F.col("_cum"), shares[1]).alias("e2"), near(F.col("_n") - F.col("_c2"), shares[2]).alias("e3"), F.col("_b").alias("b1"), F.col("_b2").alias("b2"))).alias("x"))
    cuts = stored(cuts.select("x.b1", "x.b2"))
    if cuts.first()["b1"] is None:
        raise ValueError("no feasible pair of boundaries")
    part = F.when(F.col("_b") <= F.col("b1"), names[0]).when(F.col("_b") <= F.col("b2"), names[1]).otherwise(names[2])
    return run.crossJoin(F.broadcast(cuts)).select(group, size, part.alias("part"))


def snake(rank: Column, folds: int) -> Column:
    """Fold of a rank from 1 when groups are dealt out back and forth."""
    k = (rank - 1) % (2 * folds)
    return F.when(k < folds, k).otherwise(2 * folds - 1 - k).cast("int")


def nested_folds(groups: DataFrame, group: str, size: str, outer: int = 3, inner: int = 2) -> DataFrame:
    """group, size, outer_fold and inner_folds (outer context to fold): groups by size are dealt out back and forth.

    The groups that an outer context trains on are dealt again among its inner folds, by a rank of their own in each context.
    """
    g = groups.select(group, size, F.sha2(F.concat(F.lit("outer:"), F.col(group).cast("string")), 256).alias("_h"))
    top = stored(global_rank(g, [F.desc(size), "_h"], "_rk").select(group, size, snake(F.col("_rk"), outer).alias("outer_fold")))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(outer - 1)), lambda o: o != F.col("outer_fold"))).alias("_o")
    each = top.select(group, size, others).withColumn("_h", F.sha2(F.concat(F.lit("inner:"), F.col("_o").cast("string"), F.lit(":"), F.col(group).cast("string")), 256))
    ranked = stored(global_rank(each, ["_o", F.desc(size), "_h"], "_rk"))
    base = ranked.groupBy("_o").agg((F.min("_rk") - 1).alias("_base"))  # one line an outer fold
    inside = ranked.join(F.broadcast(base), "_o").select(group, "_o", snake(F.col("_rk") - F.col("_base"), inner).alias("_i"))
    maps = inside.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_o", "_i")))).alias("inner_folds"))
    return top.join(maps, group)


def fold_support(rows: DataFrame, group: str, label: str, folds: DataFrame, outer: int = 3, inner: int = 2, least: int = 4096) -> DataFrame:
    """context_id, rows, groups, n0, n1, train_rows, train0, train1, passed of every outer and inner fold (``nested_folds``).

    A fold passes with ``least`` rows and both classes on either side. Rows of a group are counted before contexts multiply them.
    """
    per = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("ones"))
    x = per.join(folds.select(group, "outer_fold", "inner_folds"), group)
    cells = [F.struct(F.lit(f"OUTER_{o}").alias("context_id"), (F.col("outer_fold") == o).alias("test")) for o in range(outer)]
    cells += [F.struct(F.lit(f"INNER_{o}_{i}").alias("context_id"), (F.col("inner_folds")[o] == i).alias("test")) for o in range(outer) for i in range(inner)]
    long = x.select("n", "ones", F.explode(F.array(*cells)).alias("c")).select("n", "ones", "c.*").filter("test is not null")
    total = lambda e, side: F.sum(F.when(side, e).otherwise(0))
    test, zeros = F.col("test"), F.col("n") - F.col("ones")
    out = long.groupBy("context_id").agg(total(F.col("n"), test).alias("rows"), F.count_if(test).alias("groups"), total(zeros, test).alias("n0"), total(F.col("ones"), test).alias("n1"), total(F.col("n"), ~test).alias("train_rows"), total(zeros, ~test).alias("train0"), total(F.col("ones"), ~test).alias("train1"))
    return out.withColumn("passed", (F.least("rows", "train_rows") >= least) & (F.least("n0", "n1", "train0", "train1") > 0))


def groups_crossing(df: DataFrame, keys: list[str], part: str) -> DataFrame:
    """key, crossings: how many values of each key lie in more than one part."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("v")) for k in keys])
    long = df.select(part, F.explode(pairs).alias("p")).select(part, "p.*").filter("v is not null")
    per = long.groupBy("key", "v").agg((F.min(part) != F.max(part)).alias("x"))
    return per.groupBy("key").agg(F.count_if("x").alias("crossings"))


def feasibility(df: DataFrame, group: str, part: str, shares: dict[str, float], groups_least: int, rows_least: int, off: float = 0.02, most: float = 0.1) -> DataFrame:
    """check, actual, passed: number of groups, rows and share of every part, and the largest group's share."""
    per = stored(df.groupBy(group).agg(F.count("*").alias("n"), F.min(part).alias("part")))
    total = per.agg(F.sum("n").alias("all"), F.count("*").alias("groups"), F.max("n").alias("top"))
    one = per.groupBy().agg(*[F.sum(F.when(F.col("part") == p, F.col("n")).otherwise(0)).alias(p) for p in shares]).crossJoin(total)
    x = lambda n, v, ok: F.struct(F.lit(n).alias("check"), v.cast("double").alias("actual"), ok.alias("passed"))
    checks = [x("GROUPS", F.col("groups"), F.col("groups") >= groups_least)]
    for p, s in shares.items():
        share = F.try_divide(F.col(p).cast("double"), F.col("all"))
        checks += [x(f"ROWS_{p}", F.col(p), F.col(p) >= rows_least), x(f"SHARE_{p}", share, F.abs(share - s) <= off)]
    top = F.try_divide(F.col("top").cast("double"), F.col("all"))
    checks.append(x("LARGEST_GROUP", top, top <= most))
    return one.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def overlap_flags(test: DataFrame, train: DataFrame, digests: dict[str, Column]) -> DataFrame:
    """test with in_<name>: whether the digest of a row occurs in train, and ``in_any``.

    Train digests are made distinct before the join; sizes are left to the planner.
    """
    out = test
    for n, e in digests.items():
        seen = train.select(e.alias("_d")).distinct().withColumn("_hit", F.lit(True))
        out = out.withColumn("_d", e).join(seen, "_d", "left").withColumn(f"in_{n}", F.coalesce("_hit", F.lit(False))).drop("_d", "_hit")
    any_of = F.lit(False)
    for n in digests:
        any_of = any_of | F.col(f"in_{n}")
    return out.withColumn("in_any", any_of)


def first_groups(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """Rows of whole groups, in the order in which groups first appear, until the next one would pass ``limit``."""
    g = df.groupBy(group).agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    cum = running_by_value(g, "_first", {"_s": F.col("_n")})
    keep = g.join(cum.filter(F.col("cum__s") <= limit).select("_first"), "_first").select(group)
    return df.join(keep, group, "left_semi")


def allocate(sizes: DataFrame, budget: int) -> DataFrame:
    """stratum, n, take: half of the budget by size and half evenly, remainders to the largest fractions.

    ``sizes`` has one row a stratum, so its few rows are handled as one array; where a stratum is used up, the rest
    goes round the others again.
    """
    s = sizes.filter("n > 0").agg(F.array_sort(F.collect_list(F.struct("stratum", "n"))).alias("xs"))
    total = F.aggregate("xs", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    goal = F.least(F.lit(budget).cast("bigint"), total)
    raw = F.transform("xs", lambda x: F.struct(x["stratum"].alias("stratum"), x["n"].alias("n"), (0.5 * goal * (x["n"] / total) + 0.5 * goal / F.size("xs")).alias("raw")))
    s = s.select(goal.alias("goal"), F.explode(raw).alias("x")).select("goal", "x.*").withColumn("base", F.least("n", F.floor("raw")))
    few = s.groupBy().agg(F.max("goal").alias("goal"), F.array_sort(F.collect_list(F.struct((F.floor("raw") - F.col("raw")).alias("o"), "stratum", "n", "base"))).alias("xs"))
    left = F.col("goal") - F.aggregate("xs", F.lit(0).cast("bigint"), lambda a, x: a + x["base"])
    # Round r gives one to each stratum with room for r more; a rank over (round, order) says who is served.
    rounds = few.withColumn("left", left).select("left", F.posexplode("xs").alias("at", "x")).select("left", "at", "x.stratum", "x.n", "x.base")
    want = rounds.filter("left > 0 and n > base").select("left", "at", "stratum", F.explode(F.expr("sequence(1, least(left, n - base))")).alias("round"))
    served = global_rank(want, ["round", "at"], "rk").filter("rk <= left").groupBy("stratum").agg(F.count("*").alias("more"))
    return s.join(served, "stratum", "left").select("stratum", "n", (F.col("base") + F.coalesce("more", F.lit(0))).cast("bigint").alias("take"))


def fold_fit(df: DataFrame, fold: Column, folds: int, value: str) -> DataFrame:
    """fold, n, mean, deviation of ``value`` over the rows of the other folds, from one scan.

    Moments of the folds are pooled about the pooled mean, which stays exact where values are large and close.
    """
    x = F.col(value).cast("double")
    own = df.filter(fold.between(0, folds - 1) & F.col(value).isNotNull()).groupBy(fold.alias("fold")).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    whole = own.agg(F.collect_list(F.struct("fold", "n", "m", "v")).alias("xs"))  # ``folds`` entries at most

    def total(f):
        return F.aggregate("xs", F.lit(0.0), lambda a, e: a + F.when(e["fold"] == F.col("fold"), 0.0).otherwise(f(e)))

    rest = own.select("fold").crossJoin(F.broadcast(whole)).withColumn("n", total(lambda e: e["n"].cast("double")))
    rest = rest.withColumn("mean", F.try_divide(total(lambda e: e["n"] * e["m"]), F.col("n")))
    spread = F.try_divide(total(lambda e: e["n"] * (e["v"] + (e["m"] - F.col("mean")) * (e["m"] - F.col("mean")))), F.col("n"))
    return rest.select("fold", F.col("n").cast("bigint").alias("n"), "mean", F.sqrt(spread).alias("deviation"))


def leaked_rows(df: DataFrame, group: str, fold: Column, folds: int) -> DataFrame:
    """fold, n, leaked: rows of each fold, and those whose group has rows in another fold too. One shuffle by group."""
    wide = df.groupBy(group).agg(*[F.count_if(fold == k).alias(f"f{k}") for k in range(folds)])
    cells = wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), F.col(f"f{k}").alias("n")) for k in range(folds)])).alias("c"), sum((F.col(f"f{k}") for k in range(1, folds)), F.col("f0")).alias("all"))
    return cells.groupBy("c.fold").agg(F.sum("c.n").alias("n"), F.sum(F.when(F.col("all") > F.col("c.n"), F.col("c.n")).otherwise(0)).alias("leaked"))


def context_folds(group: str, outer: int = 3, inner: int = 2) -> Column:
    """fold and parts (one for each outer context) of a group, by its hashes: what ``context_roles`` tells apart."""
    fold = hash_bucket(group, outer)
    parts = [F.when(fold != o, hash_bucket(F.concat(F.lit(f"inner:{o}:"), group), inner)) for o in range(outer)]
    return F.struct(fold.alias("fold"), F.array(*parts).alias("parts"))


def roles_of(fold: Column, parts: list[Column], inner: int = 2) -> Column:
    """``context_roles`` from the numbers of a group: fixed lists of roles are picked and put together, without a lambda."""
    own = lambda c, r: F.struct(F.lit(c).alias("context_id"), F.lit(r).alias("role"))
    cells = [F.array(own("FINAL", "FIT"))]
    for o, part in enumerate(parts):
        fits = own(f"OUTER_{o}", "FIT")
        inside = [F.array(fits, *[own(f"INNER_{o}_{i}", "SCORE" if i == p else "FIT") for i in range(inner)]) for p in range(inner)]
        # A null group is in no fold: every outer context fits on it, and no inner one takes it.
        at = F.when(fold == o, 0).when(fold.isNotNull(), part + 1).otherwise(inner + 1)
        cells.append(F.get(F.array(F.array(own(f"OUTER_{o}", "SCORE")), *inside, F.array(fits)), at))
    return F.map_from_entries(F.concat(*cells))


def kept_roles(folds: str, outer: int = 3, inner: int = 2) -> Column:
    """``context_roles`` of a column of ``context_folds``, so that rows that are used often are hashed once."""
    return roles_of(F.col(folds)["fold"], [F.col(folds)["parts"][o] for o in range(outer)], inner)


def context_roles(group: str, outer: int = 3, inner: int = 2) -> Column:
    """Map of context to FIT or SCORE for a row of the group.

    OUTER_o scores fold o and fits on the other folds; INNER_o_i scores a part of the rows that OUTER_o fits on and fits on
    the rest of them; FINAL fits on all rows. The group alone decides, so that none is on both sides of a context.
    """
    return roles_of(hash_bucket(group, outer), [hash_bucket(F.concat(F.lit(f"inner:{o}:"), group), inner) for o in range(outer)], inner)
