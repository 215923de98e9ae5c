"""Near-duplicates among embeddings: an exact metric range join within labels.

Vectors become points of the sphere, where the angle is a metric and a cosine threshold a range. Cells begin as groups of
one label and one length. A cell of more than ``CELL`` points is parted by pivots of its own: every point has its home at
the nearest pivot, and is copied to another pivot's cell only where the triangle inequality leaves room for a partner
there: its angle to that pivot exceeds the one to its home's by at most twice the range. (The projection on the line of
the two pivots bounds the same thing more closely and is asked too.) Cells are parted again while they are large
and parting helps. Then cells are joined apart from each other: homes with homes, and homes with copies. A copy goes to the
earlier of two cells only, so every pair is met exactly once.

Equal vectors of a label are one point with a weight. A cell gives the number of links of each point and a forest of its
links, never the pairs. A cell that stays large, as a dense ball does, is dealt in blocks that meet in pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components, with_group
from .common import batch, dealt_join, only, stored, table

ROW = "_row"
CELL = 2048  # points of a cell that is not parted
BLOCK = 4096  # home points of one task of the join; a task meets 4 * BLOCK others at most
FAN = 32  # pivots of one parting
DEALT = 64  # tasks over which a cell's points are dealt when its pivots reach them
SLACK = 1e-6  # added to bounds, above the error of angles in double precision
CLOSE = 1e-9  # cosines so near to the threshold are computed again from the given numbers


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as rows of doubles, and the same at length 1."""
    raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return raw, scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _exactly(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(x @ y) / (float(x @ x) * float(y @ y)) ** 0.5 >= threshold


def near(a, b, threshold: float) -> np.ndarray:
    """Whether row i of ``a`` and row j of ``b`` (raw, unit) have a cosine of ``threshold`` or more."""
    cos = a[1] @ b[1].T
    hit = cos >= threshold
    for i, j in np.argwhere(np.abs(cos - threshold) < CLOSE):
        hit[i, j] = _exactly(a[0][i], b[0][j], threshold)
    return hit


def homes_and_copies(unit: np.ndarray, pivots: np.ndarray, home: np.ndarray, threshold: float):
    """The nearest pivot of every point, and a matrix of the pivots to whose cells it is copied.

    A home point is copied to earlier pivots only (a pair with homes in two cells meets in the earlier one), a copy to all
    pivots in reach: its partners are the home points of the whole cell.
    """
    cos = np.clip(unit @ pivots.T, -1, 1)
    first = cos.argmax(axis=1)
    top = cos[np.arange(len(unit)), first][:, None]
    angle = np.arccos(cos)
    least = np.take_along_axis(angle, first[:, None], 1)
    apart = np.sqrt(np.maximum(2 - 2 * np.clip(pivots @ pivots.T, -1, 1), 0))[first]
    reach = (angle - least <= 2 * np.arccos(threshold) + SLACK) & (top - cos <= (2 - 2 * threshold) ** 0.5 * apart + SLACK)
    earlier = np.arange(len(pivots))[None, :] < first[:, None]
    return first, reach & np.where(home[:, None], earlier, True)


def _runs(keys: list) -> list[tuple[int, int]]:
    cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
    return list(zip(cuts[:-1], cuts[1:], strict=True)) if keys else []


def parted(points: DataFrame, threshold: float, levels: int = 8) -> DataFrame:
    """points (cls, n, cell, home, embedding) in their last cells, with the copies that a partner may need.

    A cell is parted while it has more than CELL home points and its last parting took a fifth of them away.
    """
    vector = points.schema["embedding"].dataType.simpleString()
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("cell", pa.string()), ("home", pa.bool_()), ("before", pa.int64())])

    def deal(batches):
        for b in batches:
            b = b.filter(pa.compute.is_valid(b.column("cell")))
            cells, have = b.column("cell").to_pylist(), b.column("pivots").is_valid().to_pylist()
            for lo, hi in _runs(list(zip(cells, have, strict=True))):
                part, name = b.slice(lo, hi - lo), cells[lo]
                if not have[lo]:
                    yield pa.record_batch([*[part.column(c) for c in ("cls", "n", "cell", "home")], part.column("before"), part.column("embedding")], [*schema.names, "embedding"])
                    continue
                pivots = units(part.column("pivots")[0].values)[1]
                step = max(1, 4_000_000 // (8 * len(pivots) + 1) // 16)
                for at in range(0, len(part), step):
                    some = part.slice(at, step)
                    home = some.column("home").to_numpy(zero_copy_only=False)
                    first, copies = homes_and_copies(units(some.column("embedding"))[1], pivots, home, threshold)
                    mine = np.flatnonzero(home)
                    who, to = np.nonzero(copies)
                    rows, cell = np.append(mine, who), np.append(first[mine], to)
                    take = pa.array(rows)
                    out = batch(schema, some.column("cls").take(take), some.column("n").take(take), [f"{name}/{c}" for c in cell.tolist()], np.append(np.ones(len(mine), bool), np.zeros(len(who), bool)), some.column("homes").take(take))
                    yield pa.RecordBatch.from_arrays([*out.columns, some.column("embedding").take(take)], [*schema.names, "embedding"])

    points = points.withColumn("before", F.lit(None).cast("long"))
    for _ in range(levels):
        sizes = stored(points.groupBy("cell").agg(F.count_if("home").alias("homes"), F.max("before").alias("was")))
        large = sizes.filter(f"homes > {CELL} and (was is null or 5 * homes <= 4 * was)")
        if not large.limit(1).count():
            break
        # The least hash of each of FAN parts is a pivot: FAN rows a cell, found with partial aggregates.
        h = F.xxhash64("cls", F.lit("pivot"))
        some = points.filter("home").groupBy("cell", F.pmod(h, F.lit(FAN)).alias("k")).agg(F.min(F.struct(h.alias("h"), "embedding")).alias("p"))
        chosen = some.groupBy("cell").agg(F.sort_array(F.collect_list("p")).alias("p"))
        pivots = chosen.join(large, "cell").select("cell", "homes", F.expr(f"slice(p.embedding, 1, cast(least({FAN}, (homes + {CELL - 1}) div {CELL}) as int))").alias("pivots"))
        joined = dealt_join(points, pivots, "cell", "cls", DEALT).select("cls", "n", "cell", "home", "before", "embedding", "homes", "pivots")
        points = stored(joined.mapInArrow(deal, f"cls long, n long, cell string, home boolean, before long, embedding {vector}"))
    return points


def _merge(label: np.ndarray, rows: np.ndarray) -> None:
    """Give the groups of these rows one name."""
    met = np.unique(label[rows])
    if len(met) > 1:
        label[np.isin(label, met[1:])] = met[0]


def _join(threshold: float):
    schema = pa.schema([("cls", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])

    def close(homes, inside):
        """The homes of a task: links among themselves, and then what the copies add is kept in ``links`` and ``label``."""
        raw, unit = units(homes.column("embedding").combine_chunks())
        n = homes.column("n").to_numpy()
        links, label = np.zeros(len(n), np.int64), np.arange(len(n))
        for lo in range(0, len(n) if inside else 0, 512):
            hi = min(lo + 512, len(n))
            hit = near((raw[lo:hi], unit[lo:hi]), (raw, unit), threshold)
            hit[np.arange(hi - lo), np.arange(lo, hi)] = False
            links[lo:hi] += hit.astype(np.float64).dot(n).astype(np.int64)
            for i in np.flatnonzero(hit.any(axis=1)):
                _merge(label, np.append(np.flatnonzero(hit[i]), lo + i))
        return homes.column("cls").to_numpy(), n, (raw, unit), links, label

    def finish(state):
        names, _, _, links, label = state
        at = np.flatnonzero(links)
        return batch(schema, names[at], names[label[at]], links[at])

    def run(batches):
        key, homes, state = None, [], None
        for b in batches:
            keys = list(zip(*[b.column(c).to_pylist() for c in ("cell", "block", "part", "home")], strict=True))
            for lo, hi in _runs(keys):
                part, now = b.slice(lo, hi - lo), keys[lo]
                if now[:3] != key:
                    if homes:
                        state = close(pa.Table.from_batches(homes), key[2] == 0)
                    if state:
                        yield finish(state)
                    key, homes, state = now[:3], [], None
                if now[3]:
                    homes.append(part)
                    continue
                if homes:
                    state, homes = close(pa.Table.from_batches(homes), key[2] == 0), []
                if not state:  # copies in a cell without homes have no partner there
                    continue
                names, n, vectors, links, label = state
                for at in range(0, len(part), 512):
                    some = part.slice(at, 512)
                    hit = near(units(some.column("embedding")), vectors, threshold)
                    if not hit.any():
                        continue
                    weight = some.column("n").to_numpy()
                    links += weight.astype(np.float64).dot(hit).astype(np.int64)
                    who = np.flatnonzero(hit.any(axis=1))
                    for i in who:
                        _merge(label, np.flatnonzero(hit[i]))
                    yield batch(schema, some.column("cls").to_numpy()[who], names[hit[who].argmax(axis=1)], hit[who].astype(np.float64).dot(n).astype(np.int64))
        if homes:
            state = close(pa.Table.from_batches(homes), key[2] == 0)
        if state:
            yield finish(state)

    return run


def cell_links(points: DataFrame, threshold: float) -> DataFrame:
    """(cls, other, links): links that a task found for a point, and a point that it is joined to by them."""
    sizes = points.groupBy("cell").agg(F.count_if("home").alias("h"), F.count("*").alias("all"))
    sizes = sizes.select("cell", F.expr(f"cast((h + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks"), F.expr(f"cast((all + {4 * BLOCK - 1}) div {4 * BLOCK} as int)").alias("parts"))
    hashed = lambda of, salt: f"cast(pmod(xxhash64(cls, '{salt}'), {of}) as int)"
    rows = dealt_join(points, sizes, "cell", "cls", DEALT).filter("blocks > 0").withColumn("own", F.expr(hashed("blocks", "block"))).withColumn("mine", F.expr(hashed("parts", "part")))
    # A home point stands in every part of its block, and meets the earlier blocks as the cell's copies do.
    stands = "transform(sequence(0, parts - 1), p -> named_struct('block', own, 'part', p, 'home', true))"
    visits = "transform(sequence(0, blocks - 1), b -> named_struct('block', b, 'part', mine, 'home', false))"
    to = F.expr(f"if(home, concat({stands}, filter({visits}, v -> v.block < own)), {visits})")
    dealt = rows.select("cls", "n", "cell", "embedding", F.explode(to).alias("t")).select("cls", "n", "cell", "embedding", "t.*")
    order = ["cell", "block", "part"]
    return dealt.repartition(*order).sortWithinPartitions(*order, F.desc("home")).mapInArrow(_join(threshold), "cls long, other long, links long")


def near_duplicates(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows`` (vec_id, label, embedding).

    Linked are rows of one label (not null) and one length whose cosine reaches ``threshold``. Vectors that are null, empty or
    zero or hold null or non-finite numbers have no links and are components of their own. Rows with equal vectors are
    linked with each other; repeated vec_ids are rows of their own and fall into the same or different components; a
    null vec_id never names a component unless it has no other. An empty table gives none; other columns are left out.
    """
    rows = only(rows, "vec_id", "label", "embedding").withColumn(ROW, F.monotonically_increasing_id())
    good = F.expr("label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) <= 1.7976931348623157e308d) and exists(embedding, x -> x <> 0)")
    rows = stored(rows.withColumn("good", F.coalesce(good, F.lit(False))))
    keyed = rows.filter("good").withColumn("key", F.struct("label", "embedding"))
    first = {"_c": F.min(ROW), "_n": F.count("*"), "_v": F.min("vec_id")}
    named = stored(with_group(keyed, "key", ROW, first, {"cls": F.min("_c"), "n": F.sum("_n"), "least": F.min("_v")}).drop("key"))
    classes = named.filter(f"{ROW} = cls")

    cell = F.concat(F.col("label").cast("string"), F.lit(":"), F.size("embedding").cast("string"))
    points = stored(classes.select("cls", "n", cell.alias("cell"), F.lit(True).alias("home"), "embedding"))
    found = stored(cell_links(parted(points, threshold), threshold))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    clusters = components(found.filter("cls <> other").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    least = clusters.join(classes.select(F.col("cls").alias("node"), "least"), "node")
    least = with_group(least, "root", "node", {"_v": F.min("least")}, {"smallest": F.min("_v")}).select(F.col("node").alias("cls"), "smallest")
    per = links.join(least, "cls", "left")

    # A class may hold a third of the rows: its line is dealt over parts, and rows meet it by part.
    dealt = named.withColumn("_p", F.pmod(F.xxhash64(ROW), F.lit(DEALT)).cast("int"))
    lines = dealt.select("cls", "_p").distinct().join(per, "cls")
    ends = dealt.join(lines, ["cls", "_p"], "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component_id"))
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return ends.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.98),
reach AS (SELECT r AS a, r AS b FROM ok UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT reach.a, min(v.vec_id) AS c FROM reach JOIN v ON v.r = reach.b GROUP BY 1),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT v.vec_id, coalesce(deg.n, 0) AS n_links, CASE WHEN comp.a IS NULL THEN v.vec_id ELSE comp.c END AS component_id,
  v.vec_id IS NOT DISTINCT FROM CASE WHEN comp.a IS NULL THEN v.vec_id ELSE comp.c END AS kept
FROM v LEFT JOIN comp ON comp.a = v.r LEFT JOIN deg ON deg.a = v.r
"""
