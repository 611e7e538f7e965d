"""Clusters under exclusions: links are tried in a fixed order, and one is refused if the clusters it would join exclude each other.

Clusters exclude each other if a source gives them different ids, or, on links by name alone, if both have valid CPFs and share none. What a link meets
depends on the links before it, so one after the other would be tried. Rounds of joins give the same outcome: they decide at once every link whose clusters
already are as they will be when its turn comes.

* A conflict of ids stays whatever joins later, so such a link is refused wherever it stands.
* A cluster keeps as it is while its earlier links lead to clusters that have no earlier links of their own, and are refused, or bring nothing new. Up to
  the first link that changes it, and with that one, the links of a cluster are decided.
* A cluster that brings nothing new joins by its first link, wherever that stands among the other side's links.

So a key that a million records share takes a round for each change of its cluster, not one for each record. When few links are left one task tries them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.graph import components
from recordloom.tables import forget, written

#: Links, and CPFs of their clusters, that one task may try in order at the end.
FINISH = 20_000
#: Links from this phase on are by name alone.
BY_NAME = 5
IDS, CPFS = "ids diferentes na mesma fonte", "homônimos com CPFs diferentes"
C = F.col


def _within(some: Column, of: Column) -> Column:
    """Whether every id of one map stands in the other."""
    return F.forall(F.map_entries(some), lambda e: F.try_element_at(of, e["key"]).eqNullSafe(e["value"]))


def _judged(links: DataFrame, state: DataFrame, cpfs: DataFrame, strict: bool) -> DataFrame:
    """links (o, x, y) with what their clusters are to each other now: clash, disjoint, x_in_y, y_in_x."""
    of = lambda end: state.select(C("c").alias(end), C("ids").alias(f"{end}_ids"), C("n").alias(f"{end}_n"))
    rows = links.join(of("x"), "x").join(of("y"), "y")
    clash = F.exists(F.map_entries("x_ids"), lambda e: F.coalesce(F.try_element_at(C("y_ids"), e["key"]) != e["value"], F.lit(False)))
    flags = [clash.alias("clash"), _within(C("x_ids"), C("y_ids")).alias("x_in_y"), _within(C("y_ids"), C("x_ids")).alias("y_in_x")]
    if not strict:
        return rows.select("o", "x", "y", *flags, F.lit(False).alias("disjoint"))
    rows = written(rows.select("o", "x", "y", "x_n", "y_n", *flags), "paired")
    fewer = C("x_n") <= C("y_n")  # the side of fewer CPFs is looked up in the other
    both = rows.filter("x_n > 0 AND y_n > 0 AND NOT clash").select("o", F.when(fewer, C("x")).otherwise(C("y")).alias("few"), F.when(fewer, C("y")).otherwise(C("x")).alias("many"))
    met = both.join(cpfs.select(C("c").alias("few"), "cpf"), "few").join(cpfs.select(C("c").alias("many"), "cpf"), ["many", "cpf"]).groupBy("o").agg(F.count("*").alias("common"))
    rows = rows.join(met, "o", "left").withColumn("common", F.coalesce("common", F.lit(0)))
    disjoint = (C("x_n") > 0) & (C("y_n") > 0) & (C("common") == 0)
    return rows.select("o", "x", "y", "clash", (C("x_in_y") & (C("common") == C("x_n"))).alias("x_in_y"), (C("y_in_x") & (C("common") == C("y_n"))).alias("y_in_x"), disjoint.alias("disjoint"))


def _per_end(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    """(c, o): of each row one value for each of its two clusters."""
    return rows.select(F.explode(F.array(F.struct(C("x").alias("c"), x.alias("o")), F.struct(C("y").alias("c"), y.alias("o")))).alias("e")).select("e.*")


def _at_both(rows: DataFrame, per_cluster: DataFrame, *names: str) -> DataFrame:
    for end in ("x", "y"):
        rows = rows.join(per_cluster.select(C("c").alias(end), *(C(n).alias(f"{end}_{n}") for n in names)), end, "left")
    return rows


def _decided(judged: DataFrame) -> DataFrame:
    """judged with verdict: a reason to refuse, "" to accept, null to wait."""
    left = judged.filter("NOT clash")
    place = F.row_number().over(Window.partitionBy("c").orderBy("o"))
    two = _per_end(left, C("o"), C("o")).withColumn("r", place).filter("r <= 2")  # two a cluster, in each part before they are shuffled
    two = two.groupBy("c").agg(F.min("o").alias("first"), F.min(F.when(C("r") == 2, C("o"))).alias("second"))
    rows = written(_at_both(left, two, "first", "second"), "ends")

    def limit(own_first: str, second: str, inside: str) -> Column:
        """Up to where a link lets the other cluster keep as it is, from the end whose first and second link these are."""
        leaf = C("o") == C(own_first)
        return F.when(leaf & C("disjoint"), F.lit(None)).when(leaf & C(inside), C(second)).otherwise(C("o"))

    limits = _per_end(rows, limit("y_first", "y_second", "y_in_x"), limit("x_first", "x_second", "x_in_y")).groupBy("c").agg(F.min("o").alias("limit"))
    rows = _at_both(rows, limits, "limit")
    due = (C("x_limit").isNull() | (C("o") <= C("x_limit"))) & (C("y_limit").isNull() | (C("o") <= C("y_limit")))
    absorbed = ~C("disjoint") & (((C("o") == C("y_first")) & C("y_in_x")) | ((C("o") == C("x_first")) & C("x_in_y")))
    verdict = F.when(absorbed, "").when(due & C("disjoint"), CPFS).when(due, "")
    return rows.select("o", "x", "y", verdict.alias("verdict")).union(judged.filter("clash").select("o", "x", "y", F.lit(IDS)))


def _renamed(links: DataFrame, label: DataFrame) -> DataFrame:
    """links between the clusters that label (node, component) makes of theirs; those inside one cluster go."""
    for end in ("x", "y"):
        links = links.join(label.select(C("node").alias(end), C("component").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return links.filter("x <> y")


def _replay(rows: pd.DataFrame) -> pd.DataFrame:
    """The last links in their order, with the clusters they lead to."""
    nodes = rows[rows.kind == "node"]
    parent = {int(c): int(c) for c in nodes.x}
    ids = {int(r.x): dict(r.ids or ()) for r in nodes.itertuples()}
    cpfs = {int(r.x): set(r.cpfs if r.cpfs is not None else ()) for r in nodes.itertuples()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for e in rows[rows.kind == "link"].sort_values(["phase", "ord", "a", "b"]).itertuples():
        x, y = sorted((root(int(e.x)), root(int(e.y))))
        if x == y:
            continue
        if any(ids[y].get(s, i) != i for s, i in ids[x].items()):
            out.append((e.a, e.b, IDS))
        elif e.phase >= BY_NAME and cpfs[x] and cpfs[y] and not cpfs[x] & cpfs[y]:
            out.append((e.a, e.b, CPFS))
        else:
            parent[y] = x
            ids[x] |= ids.pop(y)
            cpfs[x] |= cpfs.pop(y)
            out.append((e.a, e.b, ""))
    return pd.DataFrame(out, columns=["a", "b", "verdict"]).astype({"a": "int64", "b": "int64"})


def _finished(links: DataFrame, state: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b, verdict) of a bounded number of links, tried in one task. held: (c, cpfs) of their clusters."""
    ends = links.select(F.explode(F.array("x", "y")).alias("c")).distinct()
    null = lambda kind: F.lit(None).cast(kind)
    nodes = state.join(ends, "c", "left_semi").join(held, "c", "left").select(
        F.lit("node").alias("kind"), C("c").alias("x"), null("long").alias("y"), null("int").alias("phase"), null("long").alias("ord"), null("long").alias("a"), null("long").alias("b"), "ids", "cpfs",
    )
    tried = links.select(F.lit("link"), "x", "y", "o.phase", "o.ord", "o.a", "o.b", null("map<string,string>"), null("array<string>"))
    return nodes.union(tried).withColumn("task", F.lit(1)).groupBy("task").applyInPandas(_replay, "a long, b long, verdict string")


def constrained(nodes: DataFrame, links: DataFrame, finish: int = FINISH) -> tuple[DataFrame, DataFrame]:
    """(rid, cluster) of every node and (a, b, reason) of every refused link.

    nodes: rid, source, id, cpf, cpf_ok. links: phase, ord, a, b, tried in this order; a link inside one cluster counts as neither. The cluster is the
    smallest rid in it. Null ids and CPFs that aren't valid exclude nothing. Empty tables give empty results. finish doesn't change the result.
    """
    spark = nodes.sparkSession
    todo = written(links.select(F.struct(C("phase").cast("int").alias("phase"), C("ord").cast("long").alias("ord"), C("a").cast("long").alias("a"), C("b").cast("long").alias("b")).alias("o"), C("a").cast("long").alias("x"), C("b").cast("long").alias("y")).filter("x <> y").distinct(), "links")
    used = nodes.join(todo.select(F.explode(F.array("x", "y")).alias("rid")).distinct(), "rid", "left_semi")
    known = F.when(C("id").isNotNull(), F.create_map(C("source").cast("string"), C("id").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    state = written(used.select(C("rid").cast("long").alias("c"), known.alias("ids"), F.when(C("cpf_ok"), 1).otherwise(0).cast("long").alias("n")), "state")
    cpfs = written(used.filter("cpf_ok").select(C("rid").cast("long").alias("c"), "cpf"), "cpfs")
    none = "a long, b long, verdict string"
    done = []
    for strict in (False, True):
        now = todo.filter(C("o.phase") >= BY_NAME if strict else C("o.phase") < BY_NAME)
        now, later = written(now, "links"), todo.filter("false") if strict else todo.filter(C("o.phase") >= BY_NAME)
        while n := now.count():
            rest = now.union(later)
            if n + later.count() <= finish:
                few = cpfs.join(rest.select(F.explode(F.array("x", "y")).alias("c")).distinct(), "c", "left_semi")
                if few.count() <= finish:
                    done.append(written(_finished(rest, state, few.groupBy("c").agg(F.collect_list("cpf").alias("cpfs"))), "verdicts"))
                    later = todo.filter("false")
                    break
            found = written(_decided(_judged(now, state, cpfs, strict)), "verdicts")
            done.append(written(found.filter("verdict is not null").select("o.a", "o.b", "verdict"), "verdicts"))
            label = components(found.filter("verdict = ''").select(C("x").alias("src"), C("y").alias("dst")))
            to = label.select(C("node").alias("c"), "component")
            moved = state.join(to, "c", "left").select(F.coalesce("component", "c").alias("c"), "ids")
            ids = moved.select("c", F.explode("ids")).distinct().groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("ids"))
            cpfs = written(cpfs.join(to, "c", "left").select(F.coalesce("component", "c").alias("c"), "cpf").distinct(), "cpfs")
            state = written(
                moved.select("c").distinct().join(ids, "c", "left").join(cpfs.groupBy("c").agg(F.count("*").alias("n")), "c", "left")
                .select("c", F.coalesce("ids", F.create_map().cast("map<string,string>")).alias("ids"), F.coalesce("n", F.lit(0)).cast("long").alias("n")), "state",
            )
            after = written(_renamed(found.filter("verdict is null").drop("verdict"), label), "links")
            if not strict:
                later = written(_renamed(later, label), "links")
            forget(now, found)
            now = after
        todo = later
    verdicts = spark.createDataFrame([], none)
    for part in done:
        verdicts = verdicts.union(part)
    joined = components(verdicts.filter("verdict = ''").select(C("a").alias("src"), C("b").alias("dst")))
    out = nodes.select("rid").join(joined, C("rid") == C("node"), "left").select("rid", F.coalesce("component", "rid").alias("cluster"))
    return out, verdicts.filter("verdict <> ''").select("a", "b", C("verdict").alias("reason"))
