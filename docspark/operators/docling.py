"""Layout trees (a body of references into arrays of nodes) to elements.

Tables: ``trees(doc_key, content)`` -> ``nodes(doc_key, node_type, idx, node)`` and ``refs`` -> ``leaves`` in the order
of a depth-first walk -> ``elements``.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import blocks as B
from docspark.functions.geometry import bbox_from_sides
from docspark.functions.ids import element_id
from docspark.functions.media import decoded_picture
from docspark.functions.python_only import dumped_json
from docspark.functions.text import let
from docspark.operators.elements import MOST_PAGES
from docspark.staging import staged

LEAVES = ("texts", "pictures", "tables")
CONTAINERS = ("groups", "body")
LEVELS = 8  # that a tree's own row is walked down
BODY = -1  # the body among the numbers of groups
MOST_LEAVES = 1_000_000  # of a document that names groups again; what is written once has no bound


def reference(child: Column) -> Column:
    """struct(node_type, idx) of a child: the text of a reference, or an object that holds one.  Null if malformed."""
    text = F.when(B.kind_of(child) == "STRING", F.try_variant_get(child, "$", "string")).otherwise(F.try_variant_get(child, "$['$ref']", "string"))
    at = lambda parts, i: F.try_element_at(parts, F.lit(i))
    named = lambda p: F.struct(at(p, 2).alias("node_type"), at(p, 3).cast("int").alias("idx"))
    return let(F.split(text, "/"), lambda p: F.when(at(p, 3).rlike(r"^-?\d{1,9}$"), named(p)))


def explode_nodes(trees: DataFrame, key: str = "doc_key", content: str = "content") -> DataFrame:
    """``nodes``: every node of the arrays, and the body as node (body, 0); ``raw`` is the JSON text of a table's data."""
    # a variant orders an object's keys by name; the data of tables is told in its own order
    raw = F.from_json(F.col(content), "tables array<struct<data:string>>")["tables"]["data"]
    parsed = trees.select(F.col(key).alias("doc_key"), F.try_parse_json(F.col(content)).alias("tree"), raw.alias("raw"))
    none = F.lit(None).cast("string").alias("raw")

    def listed(name: str) -> DataFrame:
        items = F.try_variant_get("tree", f"$.{name}", "array<variant>")
        pairs = F.transform(items, lambda x, i: F.struct(x.alias("node"), (F.get("raw", i) if name == "tables" else none).alias("raw")))
        rows = parsed.select("doc_key", F.lit(name).alias("node_type"), F.posexplode(pairs).alias("idx", "pair"))
        return rows.select("doc_key", "node_type", "idx", "pair.node", "pair.raw")

    found = [listed(name) for name in (*LEAVES, "groups")]
    nodes = parsed.select("doc_key", F.lit("body").alias("node_type"), F.lit(0).alias("idx"), F.try_variant_get("tree", "$.body", "variant").alias("node"), none)
    for other in found:
        nodes = nodes.unionByName(other)
    return nodes.where("node is not null")


def child_refs(nodes: DataFrame) -> DataFrame:
    """(doc_key, node_type, idx, child_pos, ref): the well-formed references of containers."""
    kids = nodes.where(F.col("node_type").isin(*CONTAINERS)).select(
        "doc_key", "node_type", "idx", F.posexplode(F.try_variant_get("node", "$.children", "array<variant>")).alias("child_pos", "child")
    )
    return kids.select("doc_key", "node_type", "idx", "child_pos", reference(F.col("child")).alias("ref")).where("ref is not null")


def resolve_refs(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``refs`` (doc_key, ref) with the ``node`` each names; those that name none are dropped.

    A negative index counts from the end of its array.
    """
    sizes = nodes.groupBy("doc_key", "node_type").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    r = refs.withColumn("node_type", F.col("ref.node_type")).join(sizes, ["doc_key", "node_type"])
    r = r.withColumn("idx", F.when(F.col("ref.idx") < 0, F.col("_n") + F.col("ref.idx")).otherwise(F.col("ref.idx"))).drop("_n")
    return r.join(nodes.select("doc_key", "node_type", "idx", "node"), ["doc_key", "node_type", "idx"])


def _both(*tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Tables that do not need each other, written at once."""
    with ThreadPoolExecutor(len(tables)) as pool:
        return list(pool.map(lambda t: staged(*t), tables))


def _counted(edges: DataFrame, key: str) -> tuple[DataFrame, DataFrame, int]:
    """(containers, looping, rounds) by pointer doubling: a round looks twice as far as the one before.

    ``ways`` holds how many ways lead from one container to another in exactly 2**k steps, as numbers, so that a group named
    often is never copied.  ``containers`` (doc_key, node, size, reached): the leaves below each (as many as are told, a group
    named twice counts twice), and whether the body reaches it.  ``looping``: documents whose body starts a way of as many
    steps as there are containers, which only a cycle allows.  Written tables.
    """
    spark = edges.sparkSession
    one, none = F.lit(1.0), F.lit(0.0)
    inner = edges.where("node_type = 'groups'")
    ends = inner.select("doc_key", F.col("p").alias("node")).union(inner.select("doc_key", F.col("idx").alias("node")))
    many = staged(ends.distinct().groupBy("doc_key").agg(F.count(F.lit(1)).alias("containers")), "walk-sizes")
    rows = edges.select("doc_key", F.col("p").alias("node"), F.when(F.col("node_type") == "groups", none).otherwise(one).alias("size"))
    rows = rows.union(inner.select("doc_key", F.col("idx").alias("node"), none.alias("size")))
    known = staged(rows.groupBy("doc_key", "node").agg(F.sum("size").alias("size"), (F.col("node") == BODY).alias("reached")), "walk-containers")
    ways = staged(inner.groupBy("doc_key", F.col("p").alias("top"), F.col("idx").alias("bottom")).agg(F.count(F.lit(1)).cast("double").alias("ways")), "walk-ways")
    looping, rounds = spark.createDataFrame([], f"doc_key {key}"), 0
    while True:
        # the documents whose body has a way of 2**rounds steps
        deep = ways.where(F.col("top") == BODY).select("doc_key").distinct().join(many, "doc_key")
        deep = deep.select("doc_key", (F.col("containers") <= 1 << rounds).alias("loops"))
        told = {r["loops"] for r in deep.select("loops").distinct().collect()}  # two rows at most
        if True in told:
            looping = looping.union(deep.where("loops").select("doc_key"))
        if False not in told:
            return known, looping, rounds
        ways = ways.join(deep.where("not loops").select("doc_key"), "doc_key", "left_semi")
        up = ways.join(known.where("size > 0").select("doc_key", F.col("node").alias("bottom"), "size"), ["doc_key", "bottom"])
        up = up.select("doc_key", F.col("top").alias("node"), (F.col("ways") * F.col("size")).alias("size"), F.lit(False).alias("reached"))
        down = ways.join(known.where("reached").select("doc_key", F.col("node").alias("top")), ["doc_key", "top"])
        down = down.select("doc_key", F.col("bottom").alias("node"), none.alias("size"), F.lit(True).alias("reached"))
        further = known.union(up).union(down).groupBy("doc_key", "node").agg(F.sum("size").alias("size"), F.max("reached").alias("reached"))
        on = ways.select("doc_key", F.col("top").alias("bottom"), F.col("bottom").alias("last"), F.col("ways").alias("more"))
        twice = ways.join(on, ["doc_key", "bottom"]).groupBy("doc_key", "top", F.col("last").alias("bottom")).agg(F.sum(F.col("ways") * F.col("more")).alias("ways"))
        (known, ways), rounds = _both((further, "walk-containers"), (twice, "walk-ways")), rounds + 1


def _placed(edges: DataFrame, rounds: int) -> DataFrame:
    """(doc_key, node, start) of each time that the body comes to a container; ``edges`` have ``start``, their place in ``p``.

    Again by doubling: the ways of 2**k steps carry the sum of their places, and each round joins them to all that is reached.
    """
    ways = edges.where("node_type = 'groups'").select("doc_key", F.col("p").alias("top"), F.col("idx").alias("bottom"), "start")
    come = edges.select("doc_key").distinct().select("doc_key", F.lit(BODY).alias("node"), F.lit(0).cast("long").alias("start"))
    for k in range(rounds):
        step = ways.select("doc_key", F.col("top").alias("node"), F.col("bottom").alias("to"), F.col("start").alias("more"))
        beyond = come.join(step, ["doc_key", "node"]).select("doc_key", F.col("to").alias("node"), (F.col("start") + F.col("more")).alias("start"))
        if k + 1 == rounds:
            return come.union(beyond)
        on = ways.select("doc_key", F.col("top").alias("bottom"), F.col("bottom").alias("last"), F.col("start").alias("more"))
        twice = ways.join(on, ["doc_key", "bottom"]).select("doc_key", "top", F.col("last").alias("bottom"), (F.col("start") + F.col("more")).alias("start"))
        come, ways = _both((come.union(beyond), "walk-come"), (twice, "walk-ways"))
    return come


def walk_trees(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (doc_key, element_idx, node_type, node) in depth-first order from the body, and ``bad`` trees.

    Leaves are counted first, and a leaf's place is the sum of the places on its way down, each the leaves of the siblings
    before.  Both take as many rounds as the depth has binary digits, whatever the documents' number and size, and rows
    do not grow with the depth.  A group that is named again has its leaves again.

    ``bad`` (doc_key, code, message) names trees with a cycle that the body reaches, and those whose groups are named so
    often that they have more than MOST_LEAVES leaves and more than are written in them; such trees have no leaves here and
    cost no other document.  A reference to the body names nothing.
    """
    key = dict(nodes.dtypes)["doc_key"]
    edges = resolve_refs(child_refs(nodes).select("doc_key", F.struct("node_type", "idx").alias("parent"), "child_pos", "ref"), nodes)
    edges = edges.where("node_type in ('texts', 'pictures', 'tables', 'groups')")
    p = F.when(F.col("parent.node_type") == "body", BODY).otherwise(F.col("parent.idx"))
    edges = staged(edges.select("doc_key", p.alias("p"), "child_pos", "node_type", "idx"), "walk-edges")
    known, looping, rounds = _counted(edges, key)
    written = edges.where("node_type <> 'groups'").groupBy("doc_key").agg(F.count(F.lit(1)).alias("written"))
    most = F.greatest(F.lit(MOST_LEAVES), F.coalesce("written", F.lit(0)))
    large = known.where(F.col("node") == BODY).join(written, "doc_key", "left").where(F.col("size") > most).select("doc_key")
    say = lambda rows, message: rows.select("doc_key", F.lit("docling_failed").alias("code"), F.lit(message).alias("message"))
    large = large.join(looping, "doc_key", "left_anti")
    bad = staged(say(looping, "the layout tree has a cycle").union(say(large, f"the layout tree has more than {MOST_LEAVES} leaves")), "walk-bad")
    live = known.where("reached and size > 0").join(bad.select("doc_key"), "doc_key", "left_anti").select("doc_key", "node", "size")
    steps = edges.join(live.select("doc_key", F.col("node").alias("p")), ["doc_key", "p"], "left_semi")
    below = live.select("doc_key", F.lit("groups").alias("node_type"), F.col("node").alias("idx"), "size")
    size = F.when(F.col("node_type") == "groups", F.coalesce("size", F.lit(0.0))).otherwise(1.0).cast("long")
    steps = steps.join(below, ["doc_key", "node_type", "idx"], "left").withColumn("size", size).where("size > 0")
    before = Window.partitionBy("doc_key", "p").orderBy("child_pos").rowsBetween(Window.unboundedPreceding, -1)
    steps = staged(steps.select("doc_key", "p", "node_type", "idx", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")), "walk-steps")
    come = _placed(steps, rounds).select("doc_key", F.col("node").alias("p"), F.col("start").alias("first"))
    leaves = steps.where("node_type <> 'groups'").join(come, ["doc_key", "p"])
    leaves = leaves.select("doc_key", "node_type", "idx", (F.col("first") + F.col("start")).cast("int").alias("element_idx"))
    return leaves.join(nodes, ["doc_key", "node_type", "idx"]).drop("idx"), bad


def walk(nodes: DataFrame) -> DataFrame:
    """The ``leaves`` of ``walk_trees``."""
    return walk_trees(nodes)[0]


def walk_contents(trees: DataFrame, key: str = "doc_key", content: str = "content") -> DataFrame:
    """The ``leaves`` of ``walk_trees``, with ``raw``, from contents (one row a key).

    A tree is walked where it lies, level by level: groups are replaced by their children in an array of its row, without an
    exchange.  Groups that are left after as many levels as there are groups are a cycle.  Trees with groups below LEVELS,
    those whose groups are named so often that the array outgrows what is written, and those with nodes that are null go by
    ``walk_trees``.
    """
    named = lambda name: F.coalesce(F.try_variant_get("_tree", f"$.{name}", "array<variant>"), F.array().cast("array<variant>")).alias(name)
    raw = F.from_json("content", "tables array<struct<data:string>>")["tables"]["data"]
    docs = trees.select(F.col(key).alias("doc_key"), F.col(content).alias("content")).withColumn("_tree", F.try_parse_json("content"))
    body = F.try_variant_get("_tree", "$.body", "variant").alias("body")
    docs = docs.select("doc_key", "content", body, *map(named, (*LEAVES, "groups")), raw.alias("raw"))
    size = lambda r: F.coalesce(*[F.when(r["node_type"] == t, F.size(t)) for t in (*LEAVES, "groups")], F.lit(0))

    def kids(node: Column) -> Column:
        refs = F.transform(F.try_variant_get(node, "$.children", "array<variant>"), reference)
        placed = F.transform(F.filter(refs, lambda r: r.isNotNull()), lambda r: let(size(r), lambda n: F.struct(
            r["node_type"].alias("node_type"), F.when(r["idx"] < 0, n + r["idx"]).otherwise(r["idx"]).alias("idx"), n.alias("n")
        )))
        return F.coalesce(F.filter(placed, lambda r: (r["idx"] >= 0) & (r["idx"] < r["n"])), F.array().cast("array<struct<node_type:string,idx:int,n:int>>"))

    docs = docs.withColumn("_top", kids(F.col("body"))).withColumn("_kids", F.transform("groups", kids))
    count = lambda lists: F.aggregate(lists, F.lit(0).cast("long"), lambda n, x: n + F.size(x))
    docs = docs.withColumn("_most", F.greatest(F.size("_top") + count(F.col("_kids")), F.lit(1000)))
    is_group = lambda r: r["node_type"] == "groups"

    def deeper(walked: Column, levels: int) -> Column:
        if not levels:
            return walked
        long = F.aggregate(walked, F.lit(0).cast("long"), lambda n, r: n + F.when(is_group(r), F.size(F.get("_kids", r["idx"]))).otherwise(1))
        opened = F.flatten(F.transform(walked, lambda r: F.when(is_group(r), F.get("_kids", r["idx"])).otherwise(F.array(r))))
        step = F.when(~F.exists(walked, is_group), walked).when(long <= F.col("_most"), opened)
        return let(step, lambda w: deeper(w, levels - 1))

    whole = F.lit(True)
    for name in (*LEAVES, "groups"):
        whole = whole & ~F.exists(name, lambda x: x.isNull())
    docs = docs.withColumn("_walked", F.when(whole, deeper(F.col("_top"), LEVELS)))
    docs = docs.withColumn("_left", F.exists("_walked", is_group))
    rest = F.when(F.coalesce(F.col("_left"), F.lit(True)) & (F.col("_left").isNull() | (F.size("groups") > LEVELS)), F.array(F.struct("doc_key", "content")))
    # not ``where``, nor ``explode``: filters would be pushed down, and with them all that the walk is made of
    rest = staged(docs.select(F.explode_outer(rest).alias("r")).where("r is not null").select("r.*"), "walk-rest")
    node = lambda r: F.coalesce(*[F.when(r["node_type"] == t, F.get(t, r["idx"])) for t in LEAVES])
    leaf = lambda r: F.struct(r["node_type"].alias("node_type"), node(r).alias("node"), F.when(r["node_type"] == "tables", F.get("raw", r["idx"])).alias("raw"))
    found = docs.select("doc_key", F.posexplode_outer(F.when(~F.col("_left"), F.transform("_walked", leaf))).alias("element_idx", "leaf"))
    found = found.where("leaf is not null").select("doc_key", "element_idx", "leaf.*")
    if rest.isEmpty():
        return found
    return found.unionByName(walk(staged(explode_nodes(rest), "nodes")).select(found.columns))


def route_leaves(leaves: DataFrame, sha256: Column | None = None) -> DataFrame:
    """``elements`` of the leaves, with ``too_large`` where a picture's bytes were left out."""
    node, sha256 = F.col("node"), F.col("doc_key") if sha256 is None else sha256
    prov = F.try_variant_get(node, "$.prov[0]", "variant")
    page_no = F.coalesce(F.try_variant_get(prov, "$.page_no", "int"), F.lit(0))
    box = F.coalesce(B.field(node, "bbox", "variant"), F.try_variant_get(prov, "$.bbox", "variant"))
    sides = [F.try_variant_get(box, f"$.{s}", "double") for s in "lbrt"]
    bbox = (
        F.when(B.kind_of(box).startswith("OBJECT"), bbox_from_sides(*sides))
        .when(B.kind_of(box).startswith("ARRAY"), F.try_variant_get(box, "$", "array<double>"))
        .otherwise(F.array().cast("array<double>"))
    )
    data = B.field(node, "data", "variant")
    told = F.to_json(data)
    if "raw" in leaves.columns:
        told = F.when(B.kind_of(data).rlike("^(OBJECT|ARRAY)"), F.coalesce("raw", told)).otherwise(told)
    rows = leaves.select(
        "doc_key", F.col("element_idx").cast("int").alias("seq"), "node_type", F.when(page_no == 0, 0).otherwise(page_no - 1).alias("page_idx"),
        bbox.alias("bbox"), B.field(node, "label").alias("_label"), B.first_text(node, "orig", "text").alias("_text"),
        decoded_picture(F.coalesce(F.try_variant_get(node, "$.image.uri", "string"), F.lit(""))).alias("_picture"),
        F.coalesce(B.field(node, "caption"), F.lit("")).alias("_caption"), told.alias("_data"), sha256.alias("_sha"),
    ).where(~B.bbox_is_bad(F.col("bbox")))
    is_text, is_picture, is_table = (F.col("node_type") == t for t in LEAVES)
    # one pass over what leaves are made of: only the data of tables is told to Python, null elsewhere
    rows = rows.withColumn("_data", F.when(is_table, dumped_json(F.when(is_table, F.col("_data")))))
    rows = rows.withColumn("_text", F.when(is_table, F.concat("_caption", F.lit("\n"), "_data")).otherwise(F.col("_text")))
    return rows.select(
        "doc_key", "seq", F.col("seq").alias("block_pos"), element_id(F.col("_sha"), F.col("page_idx"), F.col("seq")).alias("element_id"),
        F.when(is_text, B.label_type(F.col("_label"))).when(is_picture, "image").otherwise("table").alias("type"),
        F.when(is_picture, "").otherwise(F.col("_text")).alias("text"), F.lit("").alias("description"), "bbox", "page_idx",
        F.lit(False).alias("is_enriched"), F.when(is_picture, F.col("_picture.bytes")).alias("image_bytes"),
        (is_picture & F.col("_picture.too_large")).alias("too_large"),
    )


def size_warnings(elements: DataFrame) -> DataFrame:
    """``warnings`` of pictures that were too large."""
    message = F.concat(F.lit("Picture block "), F.col("seq").cast("string"), F.lit(" exceeds 10 MB; its bytes are left out"))
    return elements.where("too_large").select("doc_key", F.lit(None).cast("int").alias("page_idx"), F.lit("image_too_large").alias("code"), message.alias("message"))


def bad_pages(elements: DataFrame) -> DataFrame:
    """``warnings`` of documents with an element on a page beyond MOST_PAGES."""
    bad = elements.where(F.col("page_idx") >= MOST_PAGES).select("doc_key").distinct()
    said = F.lit(f"page_no is not a whole number up to {MOST_PAGES}")
    return bad.select("doc_key", F.lit("docling_error").alias("code"), said.alias("message"))
