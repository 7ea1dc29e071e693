"""Neighbours, url rules, components and the pipeline."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from plumbline.llm import ann, urlfilter
from plumbline.llm.components import components


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (7, 6), (5, 5), (20, 21), (21, 20)] + [(100, 100 + k) for k in range(1, 50)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, 10: 6, 20: 20, 21: 20} | {100 + k: 100 for k in range(50)}
    chain = [(k, k + 1) for k in range(200)]
    assert set(dict(components(spark.createDataFrame(chain, "a long, b long")).collect()).values()) == {0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(n=600, d=16):
    random = np.random.default_rng(2)
    rows = [(i, random.standard_normal(d).astype(np.float32).tolist(), 1) for i in range(n)]
    rows += [(n + k, rows[3][1], 1) for k in range(60)]
    bad = [(9000, None, 1), (9001, [], 1), (9002, [0.0] * d, 1), (9003, [float("nan")] * d, 1), (9004, [None] * d, 1), (9005, [float("inf")] * d, 1), (9006, [1.0], 1), (None, rows[0][1], 1)]
    return rows, bad


def test_neighbours(spark):
    rows, bad = vectors()
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score int")
    got = ann.nearest(df, df["vec_id"] % 20 == 0).collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    assert sorted(found) == [i for i in ids.tolist() if i % 20 == 0]
    recall = []
    for q, mine in found.items():
        mine.sort(key=lambda r: r.rank)
        score = x @ x[q]
        score[q] = -np.inf
        assert [r.rank for r in mine] == list(range(1, 21)) and q not in {r.vec_id for r in mine}
        assert np.allclose([r.score for r in mine], [score[r.vec_id] for r in mine], atol=1e-9)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        recall.append(len({r.vec_id for r in mine} & set(ids[np.lexsort((ids, -score))][:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9
    few = ann.nearest(df.where("vec_id < 5"), df["vec_id"] == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert ann.nearest(df.where("vec_id < 0"), df["vec_id"] == 0).count() == 0


def test_neighbours_of_many_parts(spark):
    """Far more parts in a task than a query's results are held for: recall is measured against brute force."""
    random = np.random.default_rng(5)
    x = np.round(random.standard_normal((60_000, 32)), 3)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = ann.nearest(df, df["vec_id"] % 20 == 0).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 60_000
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q in range(0, 60_000, 1000):
        score = x @ x[q]
        score[q] = -np.inf
        recall.append(len(found[q] & set(np.argsort(-score)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_neighbour_groups():
    """A task's search alone: twelve parts in two groups, results trimmed many times, equal to brute force where every cell is visited."""
    random = np.random.default_rng(6)
    rows = random.standard_normal((600, 8))
    tables = ann.Tables(rows, float(np.linalg.norm(rows, axis=1).max()), 0.3, 0.1)
    vec = pa.array(rows.tolist(), pa.list_(pa.float64()))
    part, batches = np.arange(600) // 50, []
    cells = tables.cells(rows)[0]
    for g in range(2):
        mine = np.flatnonzero(part // 6 == g)
        take = pa.array(mine)
        ids = pa.array([[int(i)] for i in mine], pa.list_(pa.int64()))
        batches.append(ann._placed(len(mine), 0, vec.take(take), take, grp=part[mine] // 6, part=part[mine], t=np.zeros(len(mine), np.int32), cell=cells[mine], ids=ids))
        batches.append(ann._placed(30, 1, vec.slice(0, 30), pa.array(np.arange(30)), grp=np.full(30, g), parts=[list(range(6 * g, 6 * g + 6))] * 30, cuts=[[0.0] * 6] * 30))
    found = {}
    for out in ann._searched(tables, 3)(iter(batches)):
        for q, vid, score in zip(out["q"].to_pylist(), out["vid"].to_pylist(), out["score"].to_pylist()):
            found.setdefault(q, []).append((vid, round(score, 9)))
    every = rows @ rows.T
    assert found == {q: [(int(i), round(every[q, i], 9)) for i in np.argsort(-every[q])[:3]] for q in range(30)}


URLS = ["https://a.example.com/en/7x?q#f", "HTTP://EXAMPLE.com/en/7", "http://example.com/en/8", "http://com/en/", "http://xcom/en/", "ftp://m.example.net/de/8/9", "http://example.net/de/7", "http://b.org/es/#x", "http://b.org?/es/", "nothing", None, "", "://com/en/", "http://a.com", "http://com/EN/", "x://y://z.com/en/1", "http://a.com:80/en/1", "http://É.com/en/\n2"]


def test_urls(spark):
    got = {r.page_id: r for r in urlfilter.filter_urls(spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS)], "page_id long, url string, rule string"), urlfilter.RULES).collect()}
    for i, url in enumerate(URLS):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(r), r, v) for v, r in urlfilter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), url
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string"), urlfilter.RULES).count() == 0


def test_very_long_urls(spark):
    """A host of half a million labels, and a path of a megabyte: only the ends that rules can match are made."""
    host = "a." * 500_000
    urls = [(1, f"http://{host}example.com/en/7"), (2, f"http://{host}org/es/"), (3, "http://com/en/" + "x" * 1_000_000), (4, "http://" + "." * 1_000_000)]
    got = {r.page_id: (r.rule, r.verdict, len(r.host)) for r in urlfilter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), urlfilter.RULES).collect()}
    assert got == {1: ("example.com/en/7", "allow", 1_000_011), 2: ("org/es/", "block", 1_000_003), 3: ("com/en/", "block", 3), 4: (None, "allow", 1_000_000)}


def test_cascade_is_exact(spark):
    every = [f"k{i}".encode() for i in range(3000)]
    listed = every[::7]
    df = lambda keys: spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    cascade = urlfilter.build_cascade(df(listed), df(every))
    assert [k in cascade for k in every] == [i % 7 == 0 for i in range(3000)]
    assert len(cascade.levels) > 1


@pytest.mark.parametrize("which", ["docs", "empty"])
def test_pipeline_stages(spark, which, request, tmp_path):
    docs = request.getfixturevalue(which).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(d, 1, 0) for d in range(15, 35)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard", "secret_scans", "mixed_sources", "curve_packing"]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
    total = corpus_pipeline.run(spark, str(tmp_path))
    assert (total.count() > 0) == (which == "docs")
