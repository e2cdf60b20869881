"""Wavelet files, conversation repair and lexical search against plain versions on small tables."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geostrata.llm import chat, embedding_dedup, lexical_search, sharding, token_files, turn_repair
from geostrata.llm.wavelet import WaveletFile, encode

DOCS = "doc_id long, text string, file string, n long, terms string, pos string"  # names that operators use themselves
LONG = " ".join(f"w{i % 977} und {i}!" for i in range(30_000))
TEXTS = [
    "The fox jumps. It's I'LL done", None, "", " \n\t ", "one", LONG, "é ß 中文 😀 <|endoftext|> done", "x\x00y z\x1cw a\xa0b",
    "İstanbul ǅungla κόσμος ΟΔΟΣ", "é et ́x", "the the fox", "naïve, ÉTÉ! x² ªº ½ ###",
]


def doc_rows():
    out = [(i, t) for i, t in enumerate(TEXTS)]
    out += [(0, TEXTS[0]), (5, LONG), (None, "fox"), (None, "fox"), (None, None), (3, "another fox")]
    return [(i, t, "a", 1, "b", "c") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOCS).repartition(3)


def lib_ids(text):
    t = token_files.encoder(token_files.default_tokenizer()).tokenizer
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@pytest.mark.parametrize("n", [0, 1, 7, 8, 65_535, 65_536, 65_537, 150_000])
def test_wavelet_answers(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 200, n) ** 2).astype("<u4")
    file = WaveletFile(io.BytesIO(encode(ids, pa.table({"doc_id": [1], "n_tokens": [n]}))))
    assert (file.all() == ids).all() and file.docs().num_rows == 1
    places = rng.integers(0, max(n, 1), min(n, 500))
    assert (file.access(places) == ids[places]).all()
    for token in [*ids[:3].tolist(), 3, 1 << 20]:
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert file.count(token, a, b) == int((ids[a:b] == token).sum())
        assert (file.locate(token, a, b) == a + np.flatnonzero(ids[a:b] == token)).all()
    with pytest.raises(IndexError):
        file.access(np.array([n]))


def test_cut_files_are_refused():
    data = encode(np.arange(99, dtype="<u4"), pa.table({"doc_id": [1], "n_tokens": [99]}))
    with pytest.raises(ValueError):
        WaveletFile(io.BytesIO(data[:-5]))


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_words_encode_as_the_library_does(text):
    enc = token_files.encoder(token_files.default_tokenizer())
    assert enc.encode(text.encode()) == lib_ids(text)[:-1].tobytes()


@pytest.mark.parametrize("most", [1 << 22, 4])
def test_token_files(spark, docs, tmp_path, most):
    folder = str(tmp_path / "files")
    files = token_files.write(docs, folder, shard_tokens=most)
    got = sorted(token_files.read(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    assert (files.count() > 8) == (most == 4)
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    names = [r.doc_id for r in got if r.doc_id is not None]
    assert names == sorted(names)
    at, flat = 0, []
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
        flat += r.ids
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(lib_ids(t).tolist())) for i, t, *_ in doc_rows())
    token = int(lib_ids("fox")[0])
    counts = {r.token: r.n for r in token_files.count(spark, folder, [token, 2, 48_000]).collect()}
    assert counts == {t: flat.count(t) for t in (token, 2, 48_000)}
    found = token_files.occurrences(spark, folder, token).collect()
    assert sorted(r.position for r in found) == [i for i, t in enumerate(flat) if t == token]
    assert all(any(g.doc_id == r.doc_id and g.start + r.place == r.position for g in got) for r in found)
    part = token_files.access(spark, folder, 5, 300).collect()
    assert [r.token for r in sorted(part)] == flat[5:305]


def test_token_files_of_nothing_and_of_other_ids(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id string, text string")
    token_files.write(empty, str(tmp_path / "none"))
    assert token_files.read(spark, str(tmp_path / "none")).collect() == []
    token_files.write(spark.createDataFrame([("b", "x"), ("a", "y")], "doc_id string, text string"), str(tmp_path / "two"))
    assert [r.doc_id for r in sorted(token_files.read(spark, str(tmp_path / "two")).collect(), key=lambda r: r.start)] == ["a", "b"]


def every_repair(kinds):
    """All edit strings of short conversations with at most two insertions at a place, by cost and then letters."""
    best = None
    for letters in product("DKR", repeat=len(kinds)):
        for gaps in product(range(3), repeat=len(kinds) + 1):
            state, cost, audit, ok = 0, 0, "", True
            for i in range(len(kinds) + 1):
                for _ in range(gaps[i]):
                    state = turn_repair.AFTER[state]["a" if state == 2 else "u"]
                    cost, audit = cost + 5, audit + "I"
                if i == len(kinds):
                    break
                fault, initial = divmod(kinds[i], 4)
                edit = letters[i]
                audit += edit
                if edit == "D":
                    cost += 2
                    continue
                after = turn_repair.AFTER[state]
                want = "sua?"[initial] if edit == "K" else "a" if state == 2 else "u"
                if fault in (1, 2) or want not in after:
                    ok = False
                    break
                state, cost = after[want], cost + (edit == "R") + (5 if fault == 3 else 0)
            if ok and state in (0, 3) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def halved(kinds, piece):
    tables = [turn_repair.TABLES[k] for k in kinds]
    runs = [turn_repair.chained(tables[i:i + piece]) for i in range(0, len(tables), piece)]
    root = turn_repair.chained(runs)
    leave = turn_repair.final_state(root)
    ends, audit = turn_repair.crossings(runs, 0, leave), ""
    for j, i in enumerate(range(0, len(tables), piece)):
        states = turn_repair.crossings(tables[i:i + piece], ends[j], ends[j + 1])
        audit += "".join(turn_repair.EDITS[k][p][q][1] for k, p, q in zip(kinds[i:i + piece], states, states[1:]))
    return root[0][leave] + 5 * turn_repair.CLOSING[leave], audit + "I" * turn_repair.CLOSING[leave]


def test_repairs_equal_all_repairs():
    rng = random.Random(1)
    for _ in range(60):
        kinds = [rng.choice([0, 1, 2, 3, 1, 2, 12, 13, 14, 4, 8]) for _ in range(rng.randint(1, 4))]
        assert {halved(kinds, piece) for piece in (1, 2, 9)} == {every_repair(kinds)}, kinds


def plain_audit(rows):
    """One conversation's ``(turn, role, text)`` after damage, strings carried forward."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds, illegal = set(), [], 0
    for _, role, text in rows:
        initial = "sua".find(role[0]) % 4 if role and role[0] in "sua" else 3
        last = text.rstrip(" \t\n\x0b\x0c\r")
        kinds.append(4 * (1 if not last else 2 if (role, text) in seen else 3 if last[-1] not in ".!?" else 0) + initial)
        seen.add((role, text))
    for a, b in zip(kinds, kinds[1:]):
        illegal += ("sua?"[a % 4] + "sua?"[b % 4]) not in ("su", "ua", "au")
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = halved(kinds, 10**9) if kinds else (0, "")
    state, out, left = 0, [], iter(rows)
    for letter in audit:
        row = None if letter == "I" else next(left)
        if letter == "D":
            continue
        initial = "a" if state == 2 else "u"
        if letter == "K":
            initial = row[1][0]
        state = turn_repair.AFTER[state][initial]
        out.append((row[1] if letter == "K" else {"u": "user", "a": "assistant"}[initial]) + ":" + (row[2] if row else ""))
    faults = [sum(k // 4 == f for k in kinds) for f in (1, 2, 3)]
    return [gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()]


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        out.setdefault(conv, [])
        out[conv] += [(turn, "user" if case == 4 else role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out


def talk_rows():
    rng = random.Random(7)
    says = ["Yes.", "No!", "Why?", "so", "", " \t", "fine. ", "a\nb.", None, "é?"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(says)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(c, t, ("user", "assistant")[t % 2], f"Turn {t} of {c}.") for c in range(100, 130) for t in range(12)]
    rows += [(None, t, "user", "Hm.") for t in (None, None, 1, 2, 2)] + [(7, None, "user", "Hm.")] * 5 + [(900, 3, "user", "Only this?")]
    return rows


@pytest.mark.parametrize("bits", [12, 2])
def test_turn_repair(spark, monkeypatch, bits):
    monkeypatch.setattr(turn_repair, "RUN_BITS", bits)
    monkeypatch.setattr(turn_repair, "FAN", 1 << bits)  # several levels of runs
    rows = talk_rows() + [(901, t, ("user", "assistant")[t % 3 == 1], f"Say {t % 50}{'.' * (t % 4 > 0)}") for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.select("*", *[F.lit("x").alias(n) for n in ("pos", "conv", "kind", "edit", "turns")])
    got = {r.conv_id: list(r)[1:] for r in turn_repair.audited(turn_repair.damaged(df), df).collect()}
    assert got == {conv: plain_audit(r) for conv, r in plain_damage(rows).items()}
    legal = {}
    for r in sorted(turn_repair.repaired(df).collect(), key=lambda r: r.place):
        legal.setdefault(r.conv_id, []).append(r.role[:1])
    assert all(re.fullmatch("s?(ua)+", "".join(x)) for x in legal.values())


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repaired(none).collect() == [] and turn_repair.audited(none, none).collect() == []
    ids = spark.createDataFrame([(1,), (None,), (1,)], "conv_id long")
    want = [0] * 6 + ["", hashlib.sha256(b"").hexdigest()]
    assert [list(r)[1:] for r in turn_repair.audited(none, ids).collect()] == [want, want]


def plain_search(items, docs, k):
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(d, Counter(pattern.findall((t or "").translate(lower)))) for d, t in docs]
    total, length = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(pattern.findall((text or "").translate(lower))), []
        for d, c in found:
            m = 25 + 75 * sum(c.values()) * total // max(length, 1)
            score = sum(n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in asked.items() if t in c)
            scored += [(-score, d is None, d or 0, d)] if score > 0 else []
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return Counter(out)


@pytest.mark.parametrize("leaf, block, at_once", [(8, 8192, 2048), (1, 16, 2), (3, 7, 1)])
def test_lexical_search(spark, docs, monkeypatch, leaf, block, at_once):
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Fox", "the", "über", "x.y"]
    rows = [(i, " ".join(rng.choices(words, weights=range(44, 0, -1), k=rng.randint(0, 30)))) for i in range(100, 250)]
    rows += [rows[0]] * 30 + [(i, "rare copy fox") for i in range(300, 330)] + [(r[0], r[1]) for r in doc_rows()]
    items = [(1, "the fox"), (2, "rare copy"), (2, "rare copy"), (3, None), (4, ""), (5, "nowhere"), (None, "über w3 w3 x.y"), (6, "the fox")]
    items += [(i, " ".join(rng.choices(words, k=8))) for i in range(10, 20)]
    right = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n int, score string").repartition(4)
    left = spark.createDataFrame([(*r, 1, "c") for r in items], "item_id long, text string, item int, score string")
    got = lexical_search.search(left, right, k=10, at_once=at_once)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain_search(items, rows, 10)
    assert lexical_search.search(left, right.limit(0)).collect() == [] and lexical_search.search(left.limit(0), right).collect() == []


def test_bounds_hold_for_every_document_below():
    rng = np.random.default_rng(5)
    vectors = {tuple(sorted(rng.choice(30, rng.integers(1, 9), replace=False).tolist())): i for i in range(200) for i in [i]}
    pairs = [(np.array(t, np.int64), rng.integers(1, 9, len(t))) for t in vectors]
    trie = lexical_search.Trie(pairs, rng.integers(25, 300, len(pairs)), [[i] for i in range(len(pairs))])
    todo, seen = [trie.root], 0
    while todo:
        node = todo.pop()
        most = dict(zip(node.terms.tolist(), node.counts.tolist()))
        for i in range(node.lo, node.hi):
            assert node.m <= trie.m[i] and all(most[t] >= c for t, c in zip(*map(np.ndarray.tolist, trie.vectors[i])))
        begin = {tuple(trie.vectors[i][0][: len(trie.vectors[node.lo][0])].tolist()[:1]) for i in range(node.lo, node.hi)}
        seen += node is not trie.root and node.children is not None and len(begin) == 1
        todo += node.children or []
    assert seen


@pytest.mark.parametrize("begun_with", [None, 3])
def test_shards_of_half_equal_rows_are_even(spark, tmp_path, begun_with):
    rows = [(None, PHRASE)] * 3000 + [(i, f"{PHRASE} {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    folder = str(tmp_path / "maps")
    got = sharding.shard(df, shards=4, folder=folder, begun_with=begun_with).collect()
    sums = Counter()
    for r in got:
        sums[r.shard] += r.size
    assert len(got) == 6000 and len(sums) == 4
    assert max(sums.values()) - min(sums.values()) <= max(r.size for r in got) + sum(sums.values()) / 400
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in sums)
    last = 2 if begun_with else 1
    stored = {r.vslot: r.shard for r in sharding.load_map(spark, folder, last).collect()}
    assert all(stored[r.vslot] == r.shard and r.map_version == last for r in got)


PHRASE = "a text that very many rows hold"


@pytest.mark.parametrize("kind, scale", [("float", 1.0), ("double", 1.0), ("double", 1e200), ("double", 1e-200)])
def test_vectors_of_any_element_type_and_size(spark, kind, scale):
    rng = np.random.default_rng(8)
    near = rng.normal(size=(1, 8)) + rng.normal(size=(40, 8)) * 0.05
    x = np.vstack([near, rng.normal(size=(60, 8)), np.zeros((2, 8))]) * scale
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, 0.98).collect()}
    y = (x.astype(np.float32) if kind == "float" else x) / scale
    u = y.astype(float) / np.maximum(np.linalg.norm(y.astype(float), axis=1, keepdims=True), 1e-12)
    want = (u @ u.T >= 0.98) & ((np.arange(len(x))[:, None] - np.arange(len(x))) % 2 == 0)
    np.fill_diagonal(want, False)
    assert got == dict(enumerate(want.sum(1).tolist()))


def test_links_seen_from_one_end_count_at_both(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6, 12))[rng.integers(0, 6, 300)] + rng.normal(size=(300, 12)) * 0.08
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    whole = embedding_dedup.links_in

    def careless(graph, x, q, least, whole=False, all_links=whole):
        """Misses every link of every third query, unless all are compared."""
        for i, near in all_links(graph, x, q, least, whole=True):
            if whole or i % 3:
                yield i, near

    u = embedding_dedup.unit(x)
    want = {i: n - 1 for i, n in enumerate((u @ u.T >= 0.98).sum(1).tolist())}
    told = embedding_dedup.near_duplicates(df, 0.98, shard_rows=100)
    assert {r.vec_id: r.n_links for r in told.collect()} == want
    monkeypatch.setattr(embedding_dedup, "links_in", careless)
    for shard_rows in (100, 1000):
        found = embedding_dedup.near_duplicates(df, 0.98, shard_rows=shard_rows)
        assert {r.vec_id: r.n_links for r in found.collect()} == want


def test_crowds_of_equal_turns_and_rows_without_conversation(spark, monkeypatch):
    talk_ = [(c, t, ("user", "assistant")[t % 2], "What is this?" if t % 2 == 0 else "It is. " * 40) for c in range(20) for t in range(6)]
    rows = talk_ + [(1000, 3, "user", "What is this?")] * 90 + [(1000, 3, "assistant", "It is. " * 40)] * 7 + [(None, 1, "assistant", "It is. " * 40)] * 30
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    whole = Counter(map(str, chat.formatted(df).collect()))
    monkeypatch.setattr(chat, "SEGMENT_ROWS", 16)
    sizes = chat.segmented(df).groupBy("cid", "seg").count().agg(F.max("count")).first()[0]
    assert sizes <= 3 * 16
    assert chat.segmented(df).where("conv_id IS NULL").select("cid").distinct().count() == 30
    model = chat.fit(chat.segmented(df))
    monkeypatch.setattr(chat, "fit", lambda r: model)
    split = Counter(map(str, chat.formatted(df).collect()))
    assert sum(split.values()) == sum(whole.values()) == len(rows)
    alone = {r.role for r in chat.formatted(df).where("conv_id IS NULL").collect()}
    assert len(alone) == 1  # each decoded by itself, so all alike
