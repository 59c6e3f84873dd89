"""The link graph: nodes, edges, degrees, hubs, broken links, bridges, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import shared_folder

TYPE_COLORS = {"sources": "#4CAF50", "concepts": "#FF9800", "methods": "#2196F3", "interventions": "#9C27B0"}


def _cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder that the cluster names: neither its lineage nor what its plan knows of it goes on."""
    path = shared_folder(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nodes(pages: DataFrame) -> DataFrame:
    """(id, label, type, color, path, preview) from (page_id, path, stem, content, body)."""
    kind = X.frontmatter_type(F.col("content"))
    color = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in TYPE_COLORS.items()), F.lit("#9E9E9E"))
    return pages.select(F.col("page_id").alias("id"), X.title_line(F.col("content"), F.col("stem")).alias("label"), kind.alias("type"), color.alias("color"), "path", X.preview(F.col("body")).alias("preview"))


def stem_owner(pages: DataFrame) -> DataFrame:
    """(stem_lc, dst): of pages with the same lowered stem, the one whose path sorts last."""
    return pages.groupBy(F.lower("stem").alias("stem_lc")).agg(F.max_by("page_id", "path").alias("dst"))


def resolve(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(src, dst): distinct directed edges of links whose lowered target is a page's stem, without self links."""
    targets = links.select(F.col("page_id").alias("src"), F.lower("target").alias("stem_lc"))
    return targets.join(stem_owner(pages), "stem_lc").where("src <> dst").select("src", "dst").distinct()


def extracted_edges(pages: DataFrame, body: str = "content") -> DataFrame:
    """Edges of type EXTRACTED with confidence 1."""
    from .relations import link_occurrences

    e = resolve(link_occurrences(pages, body), pages)
    return e.select(X.edge_id(F.col("src"), F.col("dst"), F.lit("EXTRACTED")).alias("id"), F.col("src").alias("from"), F.col("dst").alias("to"), F.lit("EXTRACTED").alias("type"), F.lit(1.0).alias("confidence"))


def inferred_edges(answers: DataFrame, hashes: DataFrame) -> DataFrame:
    """Edges of a snapshot of model answers (page_id, sha256, edges array<struct<to, type, confidence, relationship>>) for pages whose content is unchanged."""
    return answered_edges(answers.join(hashes, ["page_id", "sha256"], "left_semi"))


def answered_edges(answers: DataFrame) -> DataFrame:
    """Edges of answers (page_id, edges) as they are."""
    e = answers.select("page_id", F.explode("edges").alias("e"))
    kind = X.inferred_type(F.col("e.type"), F.col("e.confidence"))
    return e.select(X.edge_id(F.col("page_id"), F.col("e.to"), kind).alias("id"), F.col("page_id").alias("from"), F.col("e.to").alias("to"), kind.alias("type"), F.coalesce("e.confidence", F.lit(0.7)).cast("double").alias("confidence"))


def latest_answers(checkpoint: DataFrame, cache: DataFrame, hashes: DataFrame) -> DataFrame:
    """(page_id, edges): each page's last answer in the checkpoint (page_id, edges, ts), else that in the cache (page_id, sha256, edges) if its content is unchanged."""
    last = checkpoint.groupBy("page_id").agg(F.max_by("edges", "ts").alias("edges"))
    cached = cache.join(hashes, ["page_id", "sha256"], "left_semi").join(last, "page_id", "left_anti").groupBy("page_id").agg(F.min_by("edges", F.to_json("edges")).alias("edges"))
    return last.unionByName(cached)


def pages_to_infer(hashes: DataFrame, answers: DataFrame) -> DataFrame:
    """Pages without an answer for their present content."""
    return hashes.join(answers, ["page_id", "sha256"], "left_anti")


def undirected(edges: DataFrame) -> DataFrame:
    """One edge for each pair of ends: the most confident, then the least (from, to)."""
    pair = Window.partitionBy(F.least("from", "to"), F.greatest("from", "to")).orderBy(F.desc("confidence"), "from", "to")
    return edges.withColumn("_r", F.row_number().over(pair)).where("_r = 1").drop("_r")


def degrees(node_ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of every node and of every other end of an edge; edges count for both ends."""
    ends = edges.select(F.explode(F.array("from", "to")).alias("id"), F.lit(1).alias("n"))
    both = node_ids.select("id", F.lit(0).alias("n")).union(ends)
    return both.groupBy("id").agg(F.sum("n").cast("long").alias("degree"))


def graph_stats(degree: DataFrame, edges: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, edges a node, density, mean, sample deviation, hub threshold, orphans, health band.

    Degrees may name ends of edges that are no page: they count for density, mean and
    deviation, while ``n_nodes`` and edges a node are of ``pages``, if given.
    """
    m = edges.agg(F.count("*").alias("n_edges"))
    d = degree.agg(F.count("*").alias("n_ends"), F.avg("degree").alias("mean"), F.coalesce(F.stddev_samp("degree"), F.lit(0.0)).alias("sd"), F.count_if(F.col("degree") == 0).alias("orphans"))
    one = d.crossJoin(F.broadcast(m))  # one row each
    if pages is not None:
        one = one.crossJoin(F.broadcast(pages.agg(F.count("*").alias("n_nodes"))))
    else:
        one = one.withColumn("n_nodes", F.col("n_ends"))
    per = F.when(F.col("n_nodes") > 0, F.col("n_edges") / F.col("n_nodes")).otherwise(0.0)
    density = F.when(F.col("n_ends") > 1, 2 * F.col("n_edges") / (F.col("n_ends") * (F.col("n_ends") - 1))).otherwise(0.0)
    band = F.when(per >= 2, "healthy").when(per >= 1, "warning").otherwise("critical")
    return one.select("n_nodes", "n_edges", per.alias("edges_per_node"), density.alias("density"), "mean", "sd", (F.col("mean") + 2 * F.col("sd")).alias("threshold"), "orphans", band.alias("band"))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    """(type, n)."""
    return edges.groupBy("type").agg(F.count("*").alias("n"))


def god_nodes(degree: DataFrame) -> DataFrame:
    """Nodes of more than the mean degree plus two sample deviations."""
    limit = degree.agg((F.avg("degree") + 2 * F.coalesce(F.stddev_samp("degree"), F.lit(0.0))).alias("limit"))
    return degree.join(F.broadcast(limit), F.col("degree") > F.col("limit")).select("id", "degree")  # one row


def hub_stubs(degree: DataFrame, pages: DataFrame, most: int = 500) -> DataFrame:
    """Hubs whose page is short, largest first."""
    sizes = pages.select(F.col("page_id").alias("id"), F.length("content").cast("long").alias("n_chars"))
    return god_nodes(degree).join(sizes, "id").where(F.col("n_chars") < most).orderBy(F.desc("degree"), "id")


def broken_links(links: DataFrame, pages: DataFrame, strip_path: bool = False) -> DataFrame:
    """Occurrences (page_id, target) whose stem is no page's; with ``strip_path`` the last part of a path counts."""
    stem = F.element_at(F.split("target", "/"), -1) if strip_path else F.col("target")
    known = pages.select(F.lower("stem").alias("stem_lc")).distinct()
    return links.withColumn("stem_lc", F.lower(stem)).join(known, "stem_lc", "left_anti").select("page_id", "target")


def phantom_hubs(links: DataFrame, pages: DataFrame, least: int = 2) -> DataFrame:
    """(target, ref_count, referrers) of missing pages that several pages name."""
    missing = broken_links(links, pages)
    return missing.groupBy("target").agg(F.count_distinct("page_id").alias("ref_count"), F.sort_array(F.collect_set("page_id")).alias("referrers")).where(F.col("ref_count") >= least).orderBy(F.desc("ref_count"), "target")


def missing_entities(links: DataFrame, pages: DataFrame, least: int = 3) -> DataFrame:
    """(target, mentions) of missing pages by occurrence."""
    return broken_links(links, pages).groupBy("target").agg(F.count("*").alias("mentions")).where(F.col("mentions") >= least)


def orphans(links: DataFrame, pages: DataFrame, exempt: tuple[str, ...] = ("overview",)) -> DataFrame:
    """Pages that no link names; a link names every page of its stem."""
    named = links.select(F.lower("target").alias("stem_lc")).distinct()
    return pages.where(~F.col("page_id").isin(*exempt)).withColumn("stem_lc", F.lower("stem")).join(named, "stem_lc", "left_anti").select("page_id")


def sparse_pages(links: DataFrame, pages: DataFrame, least: int = 2) -> DataFrame:
    """(page_id, outlinks) of pages with fewer distinct lowered targets."""
    out = links.groupBy("page_id").agg(F.count_distinct(F.lower("target")).alias("n"))
    return pages.select("page_id").join(out, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("outlinks")).where(F.col("outlinks") < least)


def inlinks(links: DataFrame, referrer: str = "page_id") -> DataFrame:
    """(target, referrers): distinct referrers by the last part of their targets, case kept, self links too.

    Duplicates compare referrers by stem: pass its column, where stems repeat in several kinds.
    """
    return links.groupBy(F.element_at(F.split("target", "/"), -1).alias("target")).agg(F.collect_set(referrer).alias("referrers"))


# communities


def edge_communities(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Edges with the communities (ca, cb) of their ends."""
    a = communities.select(F.col("id").alias("from"), F.col("community").alias("ca"))
    b = communities.select(F.col("id").alias("to"), F.col("community").alias("cb"))
    return edges.join(a, "from").join(b, "to")


def fragile_bridges(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(low, high, from, to): pairs of communities that one edge ties."""
    e = edge_communities(edges, communities).where("ca <> cb")
    return e.groupBy(F.least("ca", "cb").alias("low"), F.greatest("ca", "cb").alias("high")).agg(F.count("*").alias("n"), F.min("from").alias("from"), F.min("to").alias("to")).where("n = 1").drop("n")


def isolated_communities(edges: DataFrame, communities: DataFrame, least: int = 2, cap: int = 10) -> DataFrame:
    """(community, size, members): communities without an edge to another; at most ``cap`` members are listed."""
    outward = edge_communities(edges, communities).where("ca <> cb").select(F.explode(F.array("ca", "cb")).alias("community")).distinct()
    rank = F.row_number().over(Window.partitionBy("community").orderBy("id"))
    alone = communities.join(outward, "community", "left_anti").withColumn("r", rank)
    return alone.groupBy("community").agg(F.count("*").alias("size"), F.sort_array(F.collect_list(F.when(F.col("r") <= cap, F.col("id")))).alias("members")).where(F.col("size") >= least)


def community_summary(communities: DataFrame, degree: DataFrame, top: int = 5) -> DataFrame:
    """(community, size, members): the ``top`` members of highest degree."""
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id"))
    rows = communities.join(degree, "id").withColumn("r", rank)
    best = F.collect_list(F.when(F.col("r") <= top, F.struct("r", "id")))
    return rows.groupBy("community").agg(F.count("*").alias("size"), F.transform(F.sort_array(best), lambda x: x.id).alias("members"))


def _joined(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that never broadcasts: a table that is sent through the driver in each of a hundred rounds adds up there."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def louvain(node_ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community): modularity communities of an undirected graph; isolated nodes are their own.

    Synchronous local moves: in each sweep a node joins the neighbouring community
    of highest gain, ties to the largest, and only towards smaller labels on even
    and larger on odd sweeps. Such moves are kept if modularity grows. If not, only
    moves that share no community are made: of those that a community is an end of, it takes the one of
    most gain, and a move needs both of its ends; their gains add up. So every
    sweep raises modularity, sums are whole numbers, and sweeps end when no node gains
    by any move. Levels aggregate communities to weighted nodes,
    until nothing merges. At the end a community that its edges don't hold together is
    split, which raises modularity again. Work is joins and grouped sums at every size,
    so no adjacency list is gathered; the driver sees two numbers a sweep.
    """
    both = edges.where("`from` <> `to`").select(F.col("from").cast("string").alias("a"), F.col("to").cast("string").alias("b"), F.lit(1).cast("long").alias("w"))
    graph = _cut_lineage(both.union(both.select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("w")))
    total = graph.agg(F.sum("w").alias("t")).first()["t"]
    whole = node_ids.select(F.col("id").cast("string").alias("id")).union(graph.select("a")).distinct().select("id", F.col("id").alias("community"))
    if not total:
        return whole
    member = _cut_lineage(whole)
    while True:
        weight = graph.groupBy("a").agg(F.sum("w").alias("k"))
        label = _cut_lineage(weight.select("a", "k", F.col("a").alias("c")))
        worth = _worth(graph, label, total)
        sweep = moved = 0
        while True:
            wanted = _cut_lineage(_moves(graph, label, total))
            if wanted.isEmpty():
                break
            way = (F.col("to") < F.col("c")) if sweep % 2 == 0 else (F.col("to") > F.col("c"))
            sweep += 1
            fresh = _cut_lineage(_moved(label, wanted.where(way)))
            after = _worth(graph, fresh, total)
            if after <= worth:
                chosen = _apart(wanted)
                fresh = _cut_lineage(_moved(label, chosen))
                after = worth + 2 * int(chosen.agg(F.sum("gain").alias("n")).first()["n"])
            label, worth = fresh, after
            moved += 1
        if not moved:
            return connected_parts(both.select("a", "b"), member)
        names = label.groupBy("c").agg(F.min("a").alias("n"))
        label = _cut_lineage(_joined(label, names, "c").select("a", F.col("n").alias("c")))
        member = _cut_lineage(_joined(member, label.select(F.col("a").alias("community"), "c"), "community", "left").select("id", F.coalesce("c", "community").alias("community")))
        left, right = label.select("a", F.col("c").alias("ca")), label.select(F.col("a").alias("b"), F.col("c").alias("cb"))
        graph = _cut_lineage(_joined(_joined(graph, left, "a"), right, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))


def _worth(graph: DataFrame, label: DataFrame, total: int) -> int:
    """Modularity of labels times the square of ``total``, a whole number."""
    left, right = label.select("a", F.col("c").alias("ca")), label.select(F.col("a").alias("b"), F.col("c").alias("cb"))
    inside = _joined(_joined(graph, left, "a"), right, "b").where("ca = cb").agg(F.sum("w").alias("n")).first()["n"] or 0
    squares = label.groupBy("c").agg(F.sum("k").cast("decimal(19,0)").alias("kc")).agg(F.sum(F.col("kc") * F.col("kc")).alias("n")).first()["n"]
    return total * inside - int(squares)


def _moves(graph: DataFrame, label: DataFrame, total: int) -> DataFrame:
    """(a, c, to, gain): of each node that gains by leaving its community, the best move."""
    sums = label.groupBy("c").agg(F.sum("k").alias("kc"))
    near = _joined(graph.where("a <> b"), label.select(F.col("a").alias("b"), F.col("c").alias("cb")), "b").groupBy("a", F.col("cb").alias("c")).agg(F.sum("w").alias("kin"))
    own = _joined(label, sums, "c").select("a", "k", F.col("c").alias("now"), F.col("kc").alias("know"))
    wide = lambda c: c.cast("decimal(19,0)")
    options = _joined(_joined(near, own, "a"), sums, "c")
    here = F.col("c") == F.col("now")
    rest = F.col("kc") - F.when(here, F.col("k")).otherwise(0)
    options = options.withColumn("gain", wide(F.col("kin")) * wide(F.lit(total)) - wide(F.col("k")) * wide(rest))
    best = options.groupBy("a").agg(
        F.first("now").alias("c"),
        F.max(F.when(here, F.col("gain"))).alias("stay"),
        # without a neighbour in its own community a node leaves the others behind
        F.max(-wide(F.col("k")) * wide(F.col("know") - F.col("k"))).alias("alone"),
        F.max(F.when(~here, F.struct("gain", F.col("c").alias("to")))).alias("go"),
    )
    gain = F.col("go.gain") - F.coalesce("stay", "alone")
    return best.select("a", "c", F.col("go.to").alias("to"), gain.alias("gain")).where("gain > 0")


def _apart(moves: DataFrame) -> DataFrame:
    """Moves of which no two share a community, so that their gains add up: each is the best of both its ends. The best of all is always among them."""
    order = F.struct("gain", "a")
    best = moves.select("gain", "a", F.explode(F.array("c", "to")).alias("end")).groupBy("end").agg(F.max(order).alias("top"))
    top = best.select(F.col("top.a").alias("a")).groupBy("a").agg(F.count("*").alias("n")).where("n = 2")
    return _cut_lineage(_joined(moves, top.select("a"), "a", "left_semi"))


def _moved(label: DataFrame, moves: DataFrame) -> DataFrame:
    return _joined(label, moves.select("a", "to"), "a", "left").select("a", "k", F.coalesce("to", "c").alias("c"))


def connected_parts(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(id, community): the connected parts of each community over ``edges`` (a, b), named after their smallest member.

    Each round takes the smallest label around a node and then that label's own, until none changes.
    """
    near, far = (communities.select(F.col("id").alias(x), F.col("community").alias(f"c{x}")) for x in "ab")
    inside = _joined(_joined(edges, near, "a"), far, "b").where("ca = cb").select("a", "b")
    inside = _cut_lineage(inside.union(inside.select("b", "a")).distinct())
    label = communities.select("id", F.col("id").alias("community"))
    while True:
        around = _joined(inside, label.select(F.col("id").alias("b"), "community"), "b").groupBy("a").agg(F.min("community").alias("least"))
        step = _joined(label, around.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("community").alias("old"), F.least("community", "least").alias("to"))
        step = _cut_lineage(step)
        ahead = step.select(F.col("id").alias("to"), F.col("to").alias("next"))
        fresh = _cut_lineage(_joined(step, ahead, "to").select("id", "old", F.col("next").alias("community")))
        if fresh.where("community <> old").isEmpty():
            return fresh.select("id", "community")
        label = fresh.select("id", "community")


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: the modularity of a partition of an undirected graph."""
    e = edge_communities(edges.select(F.col("from").cast("string").alias("from"), F.col("to").cast("string").alias("to")), communities)
    m = e.agg(F.count("*").alias("m"), F.count_if(F.col("ca") == F.col("cb")).alias("inside"))
    ends = e.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count("*").alias("d"))
    squares = ends.agg(F.sum(F.col("d") * F.col("d")).alias("sq"))
    return m.crossJoin(F.broadcast(squares)).select((F.col("inside") / F.col("m") - F.col("sq") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


# What the report advises where a section has rows.
ACTIONS = {"orphans": "link orphan pages", "phantoms": "create missing pages", "bridges": "strengthen fragile bridges", "hubs": "review hub pages"}


def insight_report(pages: DataFrame, links: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(section, item, n): orphans, hubs, phantoms, bridges, communities, health and actions of a wiki in one table.

    ``edges`` are undirected, ``communities`` are (id, community).
    """
    degree = degrees(pages.select(F.col("page_id").alias("id")), edges)
    row = lambda df, section, item, n: df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), n.cast("long").alias("n"))
    parts = [
        row(orphans(links, pages), "orphans", F.col("page_id"), F.lit(0)),
        row(god_nodes(degree), "hubs", F.col("id"), F.col("degree")),
        row(phantom_hubs(links, pages), "phantoms", F.col("target"), F.col("ref_count")),
        row(fragile_bridges(edges, communities), "bridges", F.concat_ws("|", "low", "high"), F.lit(1)),
        row(communities.groupBy("community").agg(F.count("*").alias("k")), "communities", F.col("community"), F.col("k")),
        row(graph_stats(degree, edges, pages), "health", F.col("band"), F.col("n_edges")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    advice = F.coalesce(*(F.when(F.col("section") == k, F.lit(v)) for k, v in ACTIONS.items()))
    actions = out.where(F.col("section").isin(*ACTIONS)).groupBy("section").agg(F.count("*").alias("k"))
    return out.union(row(actions, "actions", advice, F.col("k")))


# views of a graph


def filter_edges(edges: DataFrame, kinds: tuple[str, ...] | None = None, least: float = 0.0) -> DataFrame:
    out = edges.where(F.col("confidence") >= least)
    return out.where(F.col("type").isin(*kinds)) if kinds else out


def search_nodes(node_rows: DataFrame, query: str) -> DataFrame:
    return node_rows.where(F.lower("label").contains(query.lower()))


def neighbourhood(edges: DataFrame, ids: DataFrame, least: float = 0.0) -> DataFrame:
    """Ids and their one-hop neighbours over edges of at least a confidence; an edge whose source is chosen adds its target, else the other way round."""
    e = edges.where(F.col("confidence") >= least)
    chosen = ids.select("id")
    ahead = e.join(chosen.withColumnRenamed("id", "from"), "from", "left_semi").select(F.col("to").alias("id"))
    back = e.join(chosen.withColumnRenamed("id", "from"), "from", "left_anti").join(chosen.withColumnRenamed("id", "to"), "to", "left_semi").select(F.col("from").alias("id"))
    return chosen.union(ahead).union(back).distinct()
