"""Layout trees of any depth and number are walked whole; a cycle costs its own document only."""

import json
import random
import time

from pyspark.sql import functions as F

from docspark import EnrichmentConfig, parse_contents
from docspark.operators import docling


def leaves(spark, trees):
    rows = [(k, json.dumps(t)) for k, t in trees.items()]
    return docling.route_leaves(docling.walk(docling.explode_nodes(spark.createDataFrame(rows, "doc_key string, content string"))))


def test_a_deep_tree_keeps_its_deepest_leaf(spark):
    n = 104
    groups = [{"children": [f"#/groups/{i + 1}"]} for i in range(n - 1)] + [{"children": ["#/texts/0"]}]
    deep = {"body": {"children": ["#/groups/0", "#/texts/1"]}, "groups": groups, "texts": [{"orig": "deep"}, {"orig": "after"}]}
    assert [r.text for r in leaves(spark, {"d": deep}).orderBy("seq").collect()] == ["deep", "after"]


def test_more_nodes_than_the_recursion_limit(spark):
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "100")
    try:
        trees = {f"d{i}": {"body": {"children": ["#/groups/0"]}, "groups": [{"children": ["#/texts/0"] * 5}], "texts": [{"orig": "x"}]} for i in range(60)}
        got = leaves(spark, trees).groupBy("doc_key").agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.set(limit, before)
    assert len(got) == 60 and {r.n for r in got} == {5}


def test_a_cycle_fails_its_own_document(spark):
    texts = [{"label": "paragraph", "orig": "one"}]
    trees = {
        "loop": {"body": {"children": ["#/texts/0", "#/groups/0"]}, "groups": [{"children": ["#/groups/1"]}, {"children": ["#/groups/-2", "#/texts/0"]}], "texts": texts},
        "shared": {"body": {"children": ["#/groups/0", "#/groups/0", "#/body/0"]}, "groups": [{"children": ["#/texts/0"]}], "texts": texts},
        "apart": {"body": {"children": ["#/texts/0"]}, "groups": [{"children": ["#/groups/0"]}], "texts": texts},
    }
    rows = [(k, k, "0" * 64, json.dumps(t)) for k, t in trees.items()]
    df = spark.createDataFrame(rows, "doc_key string, file_path string, file_sha256 string, content string")
    got = {r.doc_key: r for r in parse_contents(df, EnrichmentConfig(parser="docling")).collect()}
    assert len(got) == 3 and got["loop"].elements == []
    assert [(w.code, w.message) for w in got["loop"].warnings] == [("docling_failed", "the layout tree has a cycle")]
    assert [e.text for e in got["shared"].elements] == ["one", "one"] and [e.text for e in got["apart"].elements] == ["one"]
    assert not any(w.code == "docling_failed" for k in ("shared", "apart") for w in got[k].warnings)


def test_table_data_keeps_its_own_order(spark):
    tables = [{"data": {"z": 1, "a": [2, {"y": None, "b": "é"}]}}, {"data": "said"}, {"caption": "c"}, {"data": [1.5, "x"]}]
    tree = {"body": {"children": [f"#/tables/{i}" for i in range(4)]}, "tables": tables}
    odd = {"body": {"children": ["#/tables/1"]}, "tables": ["odd", {"data": {"b": 1, "a": 2}}]}
    got = leaves(spark, {"d": tree, "o": odd}).orderBy("doc_key", "seq").collect()
    want = [t.get("caption", "") + "\n" + json.dumps(t.get("data", [])) for t in tables]
    assert [r.text for r in got if r.doc_key == "d"] == want
    # next to a table that is no object
    assert [sorted(json.loads(r.text).items()) for r in got if r.doc_key == "o"] == [[("a", 2), ("b", 1)]]


def plain_walk(tree):
    """The texts of a tree's leaves, or None for a cycle that the body reaches."""
    out, above = [], []

    def go(children):
        for ref in children:
            _, kind, at = ref.split("/")
            nodes = tree.get(kind, [])
            if not -len(nodes) <= int(at) < len(nodes):
                continue
            at = int(at) % len(nodes)
            if kind == "texts":
                out.append(nodes[at]["orig"])
            elif kind == "groups":
                if at in above:
                    raise RecursionError
                above.append(at)
                go(nodes[at]["children"])
                above.pop()

    try:
        go(tree["body"]["children"])
    except RecursionError:
        return None
    return out


def random_tree(rng, cycles):
    n, texts = rng.randrange(9), rng.randrange(5)

    def kids(at):
        lowest = 0 if cycles and rng.random() < 0.1 else at + 1
        refs = [f"#/groups/{rng.randrange(lowest, n)}" for _ in range(rng.randrange(4)) if lowest < n]
        refs += [f"#/texts/{rng.randrange(-2, texts + 1)}" for _ in range(rng.randrange(4))] + ["#/body/0"] * (rng.random() < 0.1)
        rng.shuffle(refs)
        return refs

    return {"body": {"children": kids(-1)}, "groups": [{"children": kids(i)} for i in range(n)], "texts": [{"orig": f"t{i}"} for i in range(texts)]}


def test_any_tree_is_walked_as_by_recursion(spark):
    rng = random.Random(2)
    trees = {f"d{i}": random_tree(rng, i % 2) for i in range(300)}
    rows = [(k, json.dumps(t)) for k, t in trees.items()]
    nodes = docling.explode_nodes(spark.createDataFrame(rows, "doc_key string, content string"))
    found, bad = docling.walk_trees(nodes)
    got = {}
    for r in docling.route_leaves(found).orderBy("doc_key", "seq").collect():
        got.setdefault(r.doc_key, []).append((r.seq, r.text))
    want = {k: plain_walk(t) for k, t in trees.items()}
    assert {r.doc_key for r in bad.collect()} == {k for k, w in want.items() if w is None} and len(set(map(str, want.values()))) > 100
    assert got == {k: list(enumerate(w)) for k, w in want.items() if w}


def test_five_hundred_levels_beside_others(spark):
    n = 500
    deep = {"body": {"children": ["#/groups/0", "#/texts/1"]}, "groups": [{"children": [f"#/groups/{i + 1}", "#/texts/2"]} for i in range(n - 1)] + [{"children": ["#/texts/0"]}], "texts": [{"orig": t} for t in ("deep", "after", "up")]}
    trees = {"d": deep} | {f"o{i}": {"body": {"children": ["#/texts/0"]}, "texts": [{"orig": "x"}]} for i in range(20)}
    rows = [(k, json.dumps(t)) for k, t in trees.items()]
    edges = []
    plain = docling._counted
    docling._counted = lambda *a: edges.append(plain(*a)) or edges[0]
    try:
        got = docling.route_leaves(docling.walk(docling.explode_nodes(spark.createDataFrame(rows, "doc_key string, content string"))))
    finally:
        docling._counted = plain
    assert edges[0][2] == 9  # rounds
    assert [r.text for r in got.where("doc_key = 'd'").orderBy("seq").collect()] == ["deep"] + ["up"] * (n - 1) + ["after"]
    assert got.where("doc_key <> 'd'").count() == 20


def test_groups_named_again_and_again_fail_alone(spark, monkeypatch):
    def doubled(levels):
        groups = [{"children": [f"#/groups/{i + 1}"] * 2} for i in range(levels - 1)] + [{"children": ["#/texts/0"] * 2}]
        return {"body": {"children": ["#/groups/0"]}, "groups": groups, "texts": [{"label": "text", "orig": "x"}]}

    trees = {"ten": doubled(10), "forty": doubled(40), "thousands": doubled(3000), "wide": {"body": {"children": ["#/texts/0"] * 1500}, "texts": [{"orig": "x"}]}}
    monkeypatch.setattr(docling, "MOST_LEAVES", 1100)
    rows = [(k, json.dumps(t)) for k, t in trees.items()]
    began = time.time()
    found, bad = docling.walk_trees(docling.explode_nodes(spark.createDataFrame(rows, "doc_key string, content string")))
    assert {r.doc_key: r.message for r in bad.collect()} == {k: "the layout tree has more than 1100 leaves" for k in ("forty", "thousands")}
    assert {r.doc_key: r["count"] for r in found.groupBy("doc_key").count().collect()} == {"ten": 1024, "wide": 1500} and time.time() - began < 120


def test_contents_are_walked_in_their_rows_and_as_by_recursion(spark):
    rng = random.Random(5)
    trees = {f"d{i}": random_tree(rng, i % 2) for i in range(200)}
    chain = [{"children": [f"#/groups/{i + 1}"]} for i in range(19)] + [{"children": ["#/texts/0"]}]
    trees["deep"] = {"body": {"children": ["#/groups/0"]}, "groups": chain, "texts": [{"orig": "end"}]}
    trees["wide"] = {"body": {"children": ["#/groups/0"] * 40}, "groups": [{"children": ["#/groups/1"] * 40}, {"children": ["#/texts/0"]}], "texts": [{"orig": "x"}]}
    rows = [*[(k, json.dumps(t)) for k, t in trees.items()], ("odd", "{"), ("none", None), ("null", '{"body":{"children":["#/texts/-1"]},"texts":[{"orig":"a"},null]}')]
    df = spark.createDataFrame(rows, "doc_key string, content string")
    got = {}
    for r in docling.route_leaves(docling.walk_contents(df)).orderBy("doc_key", "seq").collect():
        got.setdefault(r.doc_key, []).append(r.text)
    for k, t in trees.items():
        assert got.get(k, []) == (plain_walk(t) or []), k
    by_rounds = docling.route_leaves(docling.walk(docling.explode_nodes(df.where("doc_key in ('odd', 'none', 'null')"))))
    assert sorted((r.doc_key, r.text) for r in by_rounds.collect()) == sorted((k, x) for k in ("odd", "none", "null") for x in got.get(k, []))


def test_usual_trees_need_no_rounds(spark, monkeypatch):
    # many joins over all nodes took most of the time; a cycle is told in the row too
    monkeypatch.setattr(docling, "walk_trees", lambda nodes: 1 / 0)
    trees = {"a": {"body": {"children": ["#/groups/0", "#/texts/0"]}, "groups": [{"children": ["#/texts/-1"]}], "texts": [{"orig": "1"}, {"orig": "2"}]}}
    trees["loop"] = {"body": {"children": ["#/groups/0"]}, "groups": [{"children": ["#/groups/0", "#/texts/0"]}], "texts": [{"orig": "1"}]}
    rows = [(k, json.dumps(t)) for k, t in trees.items()]
    got = docling.route_leaves(docling.walk_contents(spark.createDataFrame(rows, "doc_key string, content string")))
    assert [(r.doc_key, r.text) for r in got.orderBy("seq").collect()] == [("a", "2"), ("a", "1")]
