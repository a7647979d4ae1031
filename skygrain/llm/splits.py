"""Splits that keep related records together: hash-to-min components, then weighted rendezvous hashing.

Records and the entities they share (an author, a place, a day) form a graph of entity nodes; a record that has two entities
links them. Every node keeps a cluster, at first itself and its neighbours. In each round a node sends its cluster to the
cluster's least member and that member to all of the cluster; when nothing changes, every node knows the least node of its
component. Clusters are kept as rows (node, member), never as lists: the least member comes from a partial aggregation, and
the cluster of a giant component is many rows of a shuffle on both columns. Rows of a node whose cluster has outgrown
HOT_ROWS stay where they are and get its least member by a broadcast of those nodes (there is at most one per HOT_ROWS rows);
the others meet theirs in a shuffle. The search ends when no node but the least ones holds anything but its least member.

Each component goes to the split with the highest -weight / ln(hash(component, split)); the choice needs no other component,
stays as it is when others come or go, and meets the proportions in expectation, up to the size of the components.

Defined results: a record whose entities are all null is a component of its own (its key); null entities link nothing;
repeated rows share their entities' component; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from skygrain.sources.scratch import written

MAX_ROUNDS = 60
#: Rows of a node's cluster beyond which they aren't shuffled by node; at most (all rows / HOT_ROWS) nodes are broadcast.
HOT_ROWS = 1_000_000


def node(axis: str, *key: Column) -> Column:
    """A node's id, null where a part of the key is null."""
    known = key[0].isNotNull()
    for k in key[1:]:
        known = known & k.isNotNull()
    return F.when(known, F.xxhash64(F.lit(axis), *key))


def components(links: DataFrame) -> DataFrame:
    """(node, component) from links (a, b): the component is its least node. b may equal a."""
    pairs = links.filter("a is not null and b is not null")
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")
    own = both.select("a", F.col("a").alias("b"))
    cluster = written(both.unionByName(own).select(F.col("a").alias("v"), F.col("b").alias("u")).distinct(), "clusters-0")
    for k in range(1, MAX_ROUNDS + 1):
        least = written(cluster.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("c")), f"least-{k}")
        if k == 1 and least.isEmpty():
            break
        open_ = Observation(f"open-{k}")
        # A row that is neither a least node's own nor points to one has news to tell; without any the clusters are stable.
        sent = _with_least(cluster, least).observe(open_, F.count_if((F.col("v") != F.col("m")) & (F.col("u") != F.col("m"))).alias("n"))
        both_ways = F.explode(F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("s")
        cluster = written(sent.select(both_ways).select("s.*").distinct(), f"clusters-{k}")
        if not open_.get["n"]:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return least.select(F.col("v").alias("node"), F.col("m").alias("component"))


def _with_least(cluster: DataFrame, least: DataFrame) -> DataFrame:
    """cluster with `m`, the least member of each node's cluster."""
    hot = least.filter(F.col("c") > HOT_ROWS).select("v", "m")
    if hot.isEmpty():
        return cluster.join(least.select("v", "m"), "v")
    cold = cluster.join(F.broadcast(hot.select("v")), "v", "left_anti").join(least.filter(F.col("c") <= HOT_ROWS).select("v", "m"), "v")
    return cold.unionByName(cluster.join(F.broadcast(hot), "v"))


def rendezvous(component: Column, weights: dict[str, float], seed: str = "split") -> Column:
    """The split of a component: the highest of -weight / ln(u), u uniform in (0, 1) from the hash of component and split."""
    scores = []
    for name, weight in sorted(weights.items()):
        u = (F.pmod(F.xxhash64(component, F.lit(seed), F.lit(name)), F.lit(2**52)) + 0.5) / float(2**52)
        scores.append(F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(name).alias("split")))
    return F.array_max(F.array(*scores))["split"] if len(scores) > 1 else F.lit(next(iter(weights)))


def assigned(records: DataFrame, key: str, first: Column, second: Column, weights: dict[str, float]) -> DataFrame:
    """Splits of records with two kinds of entity (node ids `first` and `second`).

    Columns: key, component, split (no entity of either kind is divided), first_split and second_split (entities of one kind
    alone) and blocked_split: entities of either kind draw with the roots of the weights, a record takes the split both
    agree on, else `buffer`. Within the named blocked splits no entity of either kind is divided, and their sizes stand in
    the wanted proportions also where one giant component leaves `split` no choice.
    """
    r = records.select(F.col(key).alias("_key"), first.alias("a"), second.alias("b"))
    r = r.withColumns({"x": F.coalesce("a", "b"), "y": F.coalesce("b", "a")})
    of = components(r.select(F.col("x").alias("a"), F.col("y").alias("b")))
    out = r.join(of.withColumnRenamed("node", "x"), "x", "left")
    alone = F.xxhash64(F.lit("alone"), F.col("_key"))
    out = out.withColumn("component", F.coalesce("component", alone))
    one, two = rendezvous(F.coalesce("a", alone), weights, "first"), rendezvous(F.coalesce("b", alone), weights, "second")
    roots = {k: w**0.5 for k, w in weights.items()}
    x, y = rendezvous(F.coalesce("a", alone), roots, "first root"), rendezvous(F.coalesce("b", alone), roots, "second root")
    return out.select(F.col("_key").alias(key), "component", rendezvous(F.col("component"), weights).alias("split"), one.alias("first_split"), two.alias("second_split"), F.when(x == y, x).otherwise("buffer").alias("blocked_split"))


def divided(records: DataFrame, axes: dict[str, tuple[dict[str, Column], Column]]) -> DataFrame:
    """Entities that the present labels divide: columns axis and the key names, which all axes share.

    `axes` gives an axis' key columns and its label. An entity and each of its labelled parts are nodes, every part linked to
    its entity; all axes go through one search. A component holding parts of more than one label is an entity that the
    labels divide. Null labels and entities with null keys take no part.
    """
    parts = None
    for axis, (keys, label) in axes.items():
        known = records.select(F.lit(axis).alias("axis"), *[c.alias(k) for k, c in keys.items()], label.alias("label")).dropna().distinct()
        parts = known if parts is None else parts.unionByName(known)
    names = list(next(iter(axes.values()))[0])
    one = [F.col(k) for k in ("axis", *names)]
    parts = written(parts.withColumns({"entity": F.xxhash64(F.lit("entity"), *one), "part": F.xxhash64(F.lit("part"), *one, F.col("label"))}), "parts")
    of = components(parts.select(F.col("part").alias("a"), F.col("entity").alias("b")))
    labelled = parts.join(of.withColumnRenamed("node", "part"), "part")
    several = labelled.groupBy("component").agg(F.count_distinct("label").alias("n")).filter("n > 1").select("component")
    return labelled.join(several, "component", "left_semi").select("axis", *names).distinct()
