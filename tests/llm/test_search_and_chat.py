"""Embedding near-duplicates, top-k search, chat formatting and the pipeline against plain versions."""

import itertools
import os
import sys
from collections import Counter

import numpy as np
import pytest
from oracle import TESTDATA
from pyspark.sql import functions as F

from geostrata.llm import chat, embedding_dedup, topk
from geostrata.llm.hnsw import Graph

SF_DIR = f"{TESTDATA}/sf0.001"


def plain_links(rows, least):
    """Link counts and components by comparing all usable rows of a label."""
    good = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: [] for i in range(len(rows))}
    for i, j in itertools.permutations(good, 2):
        (_, a, la), (_, b, lb) = rows[i], rows[j]
        if la == lb and len(a) == len(b):
            a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                links[i].append(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids) if ids else None))
    return Counter(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8))
    rows = [(i, base[i % 60] + rng.normal(size=8) * (0.02 if i % 4 else 1.0), i % 3) for i in range(160)]
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    rows += [rows[0], (500, rows[5][1], rows[5][2]), (501, rows[5][1], rows[5][2]), (502, [2 * x for x in rows[5][1]], rows[5][2])]
    rows += [(600, None, 1), (601, [0.0] * 8, 1), (602, [float("nan")] + [1.0] * 7, 1), (603, [float("inf")] + [1.0] * 7, 1)]
    rows += [(604, [None] + [1.0] * 7, 1), (605, rows[7][1], None), (606, [], 1), (607, [1.0, 2.0], 1), (608, [1.0, 2.0], 1), (None, rows[5][1], rows[5][2])]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.select("*", *[F.lit("clash").alias(n) for n in ("point", "v", "dim", "shard", "rank", "score")])


@pytest.mark.parametrize("shard_rows", [16_384, 20])
def test_embedding_duplicates(spark, vectors, shard_rows):
    got = embedding_dedup.near_duplicates(frame(spark, vectors), 0.98, shard_rows).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == plain_links(vectors, 0.98)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_duplicates(frame(spark, []), 0.98).collect() == []


def test_graph_finds_neighbours_and_crowds():
    rng = np.random.default_rng(4)
    far = embedding_dedup.unit(rng.normal(size=(1500, 16)))
    crowd = embedding_dedup.unit(far[:1] + rng.normal(size=(900, 16)) * 0.01)  # more neighbours than any beam
    x = np.concatenate([far, crowd])
    graph = Graph(x)
    found = dict(embedding_dedup.links_in(graph, x, x, 0.98, widest=128))
    truth = x @ x.T >= 0.98
    hits = sum(len(v) for v in found.values())
    assert all(truth[i][v].all() for i, v in found.items())
    assert hits >= 0.99 * truth.sum()
    ids, _ = graph.search(x.astype(np.float32)[:1500], 64)
    best = np.argsort(-(x[:1500] @ x.T), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids[1:], best[1:])]) >= 9


def plain_topk(rows, k, step):
    use = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in use if i % step == 0}):
        v = min((v for i, v in use if i == q), key=lambda v: (len(v), v))
        hits = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in use if i != q and len(c) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits[:k])]
    return out


@pytest.mark.parametrize("how", [{}, {"query_rows": 4, "block_rows": 30, "bits": 3}])
def test_topk(spark, vectors, how):
    rows = vectors + [(1000 + i, [1.0] * 8, 0) for i in range(60)]  # many ties
    got = topk.search(frame(spark, rows), F.col("vec_id") % 20 == 0, k=7, **how).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_topk(rows, 7, 20)
    few = rows[:5]
    got = topk.search(frame(spark, few), F.col("vec_id") % 20 == 0, k=20, **how).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_topk(few, 20, 20)
    assert topk.search(frame(spark, []), F.col("vec_id") % 20 == 0).collect() == []


def test_topk_beyond_float_precision(spark):
    rows = [(i, [2.0 ** 24 + i * 64, 2.0 ** 23 - i], 0) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = topk.search(df, F.col("vec_id") % 20 == 0, k=3).collect()
    exact = [[int(64 * a), int(64 * b)] for _, (a, b), _ in rows]
    for q in (0, 20):
        hits = sorted((-(exact[q][0] * e[0] + exact[q][1] * e[1]), i) for i, e in enumerate(exact) if i != q)[:3]
        assert sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q) == [(n + 1, i, -s) for n, (s, i) in enumerate(hits)]


def model():
    counts = chat.no_counts()
    for _ in range(30):
        before = None
        for role, text in ((0, "Answer briefly."), (1, "What is this?\nI ask."), (2, "It is a thing.\n" + "Long words " * 30), (1, "Why?")):
            chat.count_row(counts, role, chat.observe(text.split("\n")), before)
            before = role
    return chat.Model(counts)


def test_viterbi_is_the_best_path_and_segments_chain():
    m, rng = model(), np.random.default_rng(0)
    for _ in range(20):
        seen = np.stack([rng.integers(0, w, 5) for w in chat.WIDTHS], 1)
        e = m.scores(seen)

        def score(p):
            return m.start[p[0]] + e[0, p[0]] + sum(m.step[a, b] + e[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:])))

        best = max(map(score, itertools.product(range(chat.K), repeat=5)))
        assert np.isclose(score(m.decode(seen).tolist()), best)
        assert np.isclose(m.matrix(seen)[chat.K].max(), best)
        both = (m.matrix(seen[:2])[chat.K][:, None] + m.matrix(seen[2:])[:chat.K]).max()
        assert np.isclose(both, best)


def test_markers_inside_a_row_split_it():
    lines = "Human: How is it?\nTell me.\n\nAssistant: Fine.\n\n### User: Thanks".split("\n")
    turns = chat.turns_of(lines, model().decode(chat.observe(lines)))
    assert [r for r, _ in turns] == ["user", "assistant", "user"]
    assert turns[1][1].startswith("Fine.") and "Assistant" not in turns[1][1]
    assert chat.rendered("user", "hi") == "<|user|>\nhi\n<|end|>"


def talk(n):
    out = []
    for c in range(n):
        out += [(c, 0, "system", "Answer briefly."), *((c, t, ("user", "assistant")[(t - 1) % 2], ("What is this?" if t % 2 else "It is a thing. " * 20)) for t in range(1, 7))]
    return out


def test_conversations(spark, monkeypatch):
    rows = talk(40) + [(None, None, None, None), (None, 1, "user", "Why?"), (7, 3, "user", "Why?"), (7, 3, "user", "Why?"), (50, 0, "other", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit("x").alias(n) for n in ("part", "seg", "key", "mark", "cid")])
    got = chat.formatted(df).collect()
    assert {(r.conv_id, r.turn) for r in got} == {(c, t) for c, t, *_ in rows}
    known = [r for r in got if r.conv_id is not None and r.conv_id != 7 and r.conv_id < 40]
    assert np.mean([r.given == r.role for r in known]) > 0.95
    assert all(r.rendered.startswith(f"<|{r.role}|>\n") and r.rendered.endswith("\n<|end|>") for r in got)
    # a long conversation in several segments is decoded as in one
    long_rows = [(1, t, ("user", "assistant")[t % 2], "What is this?" if t % 2 == 0 else "It is. " * 40) for t in range(60)]
    frame_ = spark.createDataFrame(talk(20) + [(99 + c, *r) for c, *r in long_rows], "conv_id long, turn long, role string, text string")
    whole = sorted(map(str, chat.formatted(frame_).collect()))
    monkeypatch.setattr(chat, "SEGMENT_TURNS", 8)
    m = chat.fit(chat.segmented(frame_))
    monkeypatch.setattr(chat, "fit", lambda rows: m)
    split = sorted(map(str, chat.formatted(frame_).collect()))
    monkeypatch.setattr(chat, "SEGMENT_TURNS", 4096)
    assert sorted(map(str, chat.formatted(frame_).collect())) == split
    monkeypatch.setattr(chat, "SEGMENT_ROWS", 16)
    assert sorted(map(str, chat.formatted(frame_).collect())) == split
    assert len(whole) == len(split)
    assert chat.formatted(frame_.limit(0)).collect() == []


def plain_representatives(docs, size=5, least=0.8):
    """Smallest id of each group of texts linked by a Jaccard similarity of their word shingles, over all pairs."""
    def shingled(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()

    found, up = [(d, shingled(t)) for d, t in docs], {d: d for d, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(found):
        for b, y in found[i + 1:]:
            if root(a) != root(b) and (x == y or len(x & y) >= least * len(x | y) - 1e-9):
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    return sorted({root(d) for d, _ in docs})


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_pipeline_keeps_columns_and_every_decision_counts(spark):
    import corpus_pipeline
    from geostrata.llm import quality, secret_scan

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    at = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF_DIR).cache()
        assert at.columns == docs.columns, name
        seen.append(at)
    good, single, hidden, mixed = seen
    wanted = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == wanted
    assert sorted(r.doc_id for r in single.collect()) == plain_representatives([(r.doc_id, r.text) for r in good.collect()])
    assert hidden.count() == single.count() and secret_scan.scan(hidden).where("n_access > 0").count() == 0
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    packed = corpus_pipeline.STAGES[-1][1](spark, mixed, SF_DIR)
    assert packed.count() > 0 and packed.where("size(ids) <> length").count() == 0
    assert corpus_pipeline.run(spark, SF_DIR).count() == packed.count()


def test_entry_registers_all_operators_and_the_pipeline():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names and "geostrata.llm" in sys.modules
