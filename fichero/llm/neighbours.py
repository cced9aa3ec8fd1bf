"""Embedding near-duplicates with NN-descent.

Random hyperplanes deal the vectors into small blocks, which give every vector a first list of neighbours. Descent
then compares the neighbours of each vector, forward and reverse, with one another: a neighbour's neighbour often is
a neighbour. Pairs at or above the threshold are links and join components.

A list full of links says nothing about links beyond it. So every vector keeps two lists, its nearest inside its
component and its nearest outside; joining two components empties the outer lists that the join has filled, and blocks
and descent fill them again, until no outer list holds a link. Inside a component all pairs are compared in blocks and
only counted. A fixed sample is then compared with all vectors: the links it has outside its components are what was
missed. Below the target descent goes on from further blocks, and if it ends below the target all vectors are compared
with all others, a bounded part of them at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fichero.llm.common import prepared, staged
from fichero.llm.components import components

THRESHOLD = 0.9
#: Neighbours of a list; sets of hyperplanes a round; vectors of a block, and at most; vectors compared at once.
LIST, TREES, LEAF, MOST, BLOCK = 10, 3, 96, 256, 512
#: Vectors of the audit, the recall it asks for, audits below it before all is compared; bytes of vectors sent to tasks at once.
AUDIT, RECALL, ROUNDS, SENT = 1024, 0.99, 4, 16 << 20


def _unit(column, kind) -> np.ndarray:
    rows = np.stack([np.frombuffer(b, kind) for b in column]).astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _classes(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame, str]:
    """Rows with the hash of their vector, and one row per distinct vector that can link: (k1, k2, node, m, dim, v)."""
    kind = "<f4" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "<f8"
    length = F.aggregate(vec_col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    fine = F.coalesce(fine & (length > 0), F.lit(False)) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine, F.col(vec_col)).alias("v"))
    rows = rows.withColumn("k1", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("k2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")))
    one = rows.where("v is not null").groupBy("k1", "k2").agg(F.min("id").alias("node"), F.count("*").alias("m"), F.first("v").alias("v"))

    def packed(batches):
        for batch in batches:
            data = [np.asarray(v, kind).tobytes() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "node", "m")), pa.array([len(d) for d in data], pa.int32()), pa.array(data, pa.binary())], names=["k1", "k2", "node", "m", "dim", "v"])

    return rows.select("id", "k1", "k2"), staged(one.mapInArrow(packed, "k1 long, k2 long, node long, m long, dim int, v binary"), "vectors"), kind


def _groups(batches, key: str):
    """Whole groups of consecutive rows with one key, as lists of column values (the rows come sorted by key)."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = held.column(key).to_numpy()
        if not len(keys) or keys[0] == keys[-1]:
            continue
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
        yield held.slice(0, cut)
        held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _near(kind: str, bounded: bool):
    """For each group of members the best neighbours of each, in its component and outside; only those above the member's bounds."""

    def run(batches):
        for table in _groups(batches, "key"):
            keys, nodes, homes = (table.column(c).to_numpy() for c in ("key", "node", "home"))
            bounds = [table.column(c).to_numpy() if bounded else np.full(len(nodes), -2.0) for c in ("inner", "outer")]
            data = table.column("v").to_pylist()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            a, b, s = [], [], []
            for start, end in zip(starts, np.r_[starts[1:], len(keys)]):
                own, first = np.unique(nodes[start:end], return_index=True)
                if len(own) < 2:
                    continue
                unit = _unit([data[start + i] for i in first], kind)
                sims = unit @ unit.T
                np.fill_diagonal(sims, -3)
                home = homes[start:end][first]
                apart = home[:, None] != home
                k = min(LIST, len(own) - 1)
                for side, bound in zip((~apart, apart), bounds):
                    some = np.where(side, sims, -3)
                    best = np.argpartition(-some, k - 1, axis=1)[:, :k]
                    value = np.take_along_axis(some, best, axis=1)
                    good = value > bound[start:end][first][:, None]
                    a.append(np.repeat(own, k).reshape(-1, k)[good])
                    b.append(own[best][good])
                    s.append(value[good])
            join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0, t))
            yield pa.RecordBatch.from_arrays([join(a, np.int64), join(b, np.int64), join(s, np.float64)], names=["a", "b", "sim"])

    return run


def _leaves(kind: str, bits: int, seed: int):
    def run(batches):
        for batch in batches:
            data, dims = batch.column("v").to_pylist(), batch.column("dim").to_numpy()
            codes = np.zeros((TREES, batch.num_rows), np.int64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                unit = _unit([data[r] for r in rows], kind)
                planes = np.random.default_rng([seed, int(dim)]).standard_normal((TREES, unit.shape[1], bits))
                for t in range(TREES):
                    codes[t, rows] = ((unit @ planes[t] > 0) << np.arange(bits)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.tile(batch.column(c).to_numpy(), TREES)) for c in ("node", "home", "dim")), pa.array(data * TREES, pa.binary()), pa.array(np.repeat(np.arange(TREES), batch.num_rows)), pa.array(codes.reshape(-1))], names=["node", "home", "dim", "v", "tree", "code"])

    return run


def _first_lists(nodes: DataFrame, home: DataFrame, count: int, kind: str, seed: int) -> DataFrame:
    bits = max(1, math.ceil(math.log2(max(2, count / LEAF))))
    dealt = nodes.join(home, "node").select("node", "home", "dim", "v").mapInArrow(_leaves(kind, bits, seed), "node long, home long, dim int, v binary, tree long, code long")
    sizes = dealt.groupBy("dim", "tree", "code").agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("node", "tree", F.lit(seed)), F.ceil(F.col("n") / MOST))
    keyed = dealt.join(sizes, ["dim", "tree", "code"]).select(F.xxhash64("dim", "tree", "code", salt).alias("key"), "node", "home", "v")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_near(kind, False), "a long, b long, sim double")


def _shortened(lists: DataFrame, home: DataFrame) -> DataFrame:
    """(a, b, sim, ha, hb): the nearest of each vector in its component and the nearest outside, with both components."""
    best = Window.partitionBy("a", F.col("ha") == F.col("hb")).orderBy(F.desc("sim"), "b")
    lists = lists.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    lists = lists.join(home.toDF("a", "ha"), "a").join(home.toDF("b", "hb"), "b")
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= LIST).select("a", "b", "sim", "ha", "hb")


def _descended(lists: DataFrame, nodes: DataFrame, home: DataFrame, kind: str) -> DataFrame:
    """Better neighbours among the neighbours of each vector; a vector many point to is dealt out in parts."""

    def bound(side):
        return F.when(F.count(F.when(side, 1)) == LIST, F.min(F.when(side, F.col("sim")))).otherwise(-2.0)

    bounds = lists.groupBy("a").agg(bound(F.col("ha") == F.col("hb")).alias("inner"), bound(F.col("ha") != F.col("hb")).alias("outer")).withColumnRenamed("a", "node")
    held = nodes.join(home, "node").join(bounds, "node", "left").select("node", "home", "v", *(F.coalesce(c, F.lit(-2.0)).alias(c) for c in ("inner", "outer")))
    both = lists.select(F.col("a").alias("centre"), F.col("b").alias("node")).unionByName(lists.select(F.col("b").alias("centre"), F.col("a").alias("node")))
    both = both.unionByName(lists.select(F.col("a").alias("centre"), F.col("a").alias("node")).distinct())
    sizes = both.groupBy("centre").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / (4 * LIST)))
    keyed = both.join(sizes, "centre").select(F.xxhash64("centre", part).alias("key"), "node").join(held, "node")
    return keyed.select("key", "node", "home", "v", "inner", "outer").repartition("key").sortWithinPartitions("key").mapInArrow(_near(kind, True), "a long, b long, sim double")


def _joined(home: DataFrame, links: DataFrame) -> DataFrame | None:
    """``home(node, home)`` after ``links(a, b)`` between components; None where there are none."""
    links = staged(links.distinct(), "joins")
    if links.isEmpty():
        return None
    up = components(links).withColumnRenamed("node", "home")
    return staged(home.join(up, "home", "left").select("node", F.coalesce("component", "home").alias("home")), "homes")


def _links(kind: str, threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["block"].to_numpy()
        unit, nodes, m = _unit(rows["v"], kind), rows["node"].to_numpy(), rows["m"].to_numpy()
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        one, two = np.flatnonzero(side == i), np.flatnonzero(side == j)
        near = unit[one] @ unit[two].T >= threshold
        if i == j:
            np.fill_diagonal(near, False)
        out = [pd.DataFrame({"node": nodes[one], "links": near @ m[two]})]
        if i != j:
            out.append(pd.DataFrame({"node": nodes[two], "links": near.T @ m[one]}))
        return pd.concat(out)

    return run


def _counted(member: DataFrame, nodes: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(node, links): links of each vector within its component, in blocks; pairs are counted, not given out."""
    sizes = member.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    rows = member.join(sizes, "component").join(nodes.select("node", "m", "v"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return rows.groupBy("component", "i", "j").applyInPandas(_links(kind, threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _compared(some: list, nodes: DataFrame, kind: str, threshold: float, outside: bool) -> DataFrame:
    """(node, home, other, links): links of ``some`` with all vectors, by component; only those outside their own, if asked."""
    sent = nodes.sparkSession.sparkContext.broadcast([(r["node"], r["home"], r["dim"], bytes(r["v"])) for r in some])

    def run(batches):
        own = {}
        for dim in {r[2] for r in sent.value}:
            rows = [r for r in sent.value if r[2] == dim]
            own[dim] = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), _unit([r[3] for r in rows], kind)
        for batch in batches:
            dims, data, m = batch.column("dim").to_numpy(), batch.column("v").to_pylist(), batch.column("m").to_numpy()
            ids, homes = batch.column("node").to_numpy(), batch.column("home").to_numpy()
            for dim in np.unique(dims):
                if dim not in own:
                    continue
                rows = np.flatnonzero(dims == dim)
                unit, other = _unit([data[r] for r in rows], kind), homes[rows]
                for at in range(0, len(own[dim][0]), BLOCK):
                    node, home, side = (x[at : at + BLOCK] for x in own[dim])
                    near = side @ unit.T >= threshold
                    near &= home[:, None] != other if outside else node[:, None] != ids[rows]
                    i, j = np.nonzero(near)
                    key, where = np.unique(np.stack((i, other[j])), axis=1, return_inverse=True)
                    links = np.bincount(where.reshape(-1), m[rows][j], key.shape[1]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[key[0]], home[key[0]], key[1], links)], names=["node", "home", "other", "links"])

    return nodes.mapInArrow(run, "node long, home long, other long, links long")


def _audit(nodes: DataFrame, home: DataFrame, kind: str, threshold: float) -> tuple[float, DataFrame]:
    """The share of a bounded sample's links that lie in its components, or of its linked vectors with all links there if that is less; and the links missed."""
    held = nodes.join(home, "node")
    sample = held.orderBy(F.xxhash64("node"), "node").limit(AUDIT).select("node", "home", "dim", "v").collect()
    seen = staged(_compared(sample, held, kind, threshold, False), "audit")
    missed = F.col("home") != F.col("other")
    per = seen.groupBy("node").agg(F.sum("links").alias("links"), F.sum(F.when(missed, F.col("links")).otherwise(0)).alias("missed"))
    links, missing, vectors, short = per.agg(F.sum("links"), F.sum("missed"), F.count("*"), F.count(F.when(F.col("missed") > 0, 1))).first()
    recall = min(1 - missing / links, 1 - short / vectors) if vectors else 1.0
    return recall, seen.where(missed).select(F.col("home").alias("a"), F.col("other").alias("b"))


def _whole(nodes: DataFrame, home: DataFrame, kind: str, threshold: float) -> DataFrame:
    """``home`` after comparing every vector with all vectors outside its component, a bounded part at a time."""
    parts = math.ceil((nodes.agg(F.sum("dim")).first()[0] or 0) / SENT) or 1
    for part in range(parts):
        held = nodes.join(home, "node")
        some = held.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(parts)) == part).select("node", "home", "dim", "v").collect()
        joined = _joined(home, _compared(some, held, kind, threshold, True).select(F.col("home").alias("a"), F.col("other").alias("b")))
        home = home if joined is None else joined
    return home


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row: links at or above ``threshold`` by cosine in double precision.

    A vector that is null, zero, or holds null or non-finite components, and a row without an id, links with nothing
    and is its own component. Vectors of different length do not link. Equal vectors are compared once and link with
    each other; a repeated row is another vector. Further columns are ignored; an empty table gives an empty table.
    """
    prepared(vectors.sparkSession)
    rows, nodes, kind = _classes(vectors, id_col, vec_col)
    count, lists, turn, short = nodes.count(), None, 0, 0
    home = nodes.select("node", F.col("node").alias("home"))
    while count > 1:
        fresh = _first_lists(nodes, home, count, kind, 7 + turn)
        lists = staged(_shortened(fresh if lists is None else lists.select("a", "b", "sim").unionByName(fresh), home), "lists")
        lists = staged(_shortened(lists.select("a", "b", "sim").unionByName(_descended(lists, nodes, home, kind)), home), "lists")
        turn += 1
        joined = _joined(home, lists.where((F.col("sim") >= threshold) & (F.col("ha") != F.col("hb"))).select(F.col("ha").alias("a"), F.col("hb").alias("b")))
        if joined is not None:
            home = joined
            continue
        recall, missed = _audit(nodes, home, kind, threshold)
        joined = _joined(home, missed)
        home = home if joined is None else joined
        if recall >= RECALL:
            break
        short += 1
        if short == ROUNDS:
            home = _whole(nodes, home, kind, threshold)
            break
    member = home.withColumnRenamed("home", "component")
    links = staged(_counted(member, nodes, kind, threshold), "links")
    found = nodes.join(member, "node", "left").join(links, "node", "left")
    found = found.select("k1", "k2", "m", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    out = rows.join(found, ["k1", "k2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce(F.col("links") + F.col("m") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
