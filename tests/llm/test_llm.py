"""Operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from pagewright.llm import ann, bpe, bpe_codec, chaining, common, graph, langid, line_dedup, packing, secrets, sharding, simhash, vector_dedup

TEXT = "doc_id long, text string, lang string, source string, n_chars long, shard int, key string, component string"


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", "c") for i, t in rows], TEXT)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(1, 80))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x" * 50_000), (103, "word " * 5_000), (104, rows[0][1]), (105, rows[0][1].upper()), (106, "é ñ 漢字 123 '\n\n\t !?"), (None, "no id here")]
    return documents(spark, [*rows, rows[1]])


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_sharding(spark, docs):
    out = sharding.shard(docs, 4).collect()
    assert len(out) == docs.count()
    want = sorted((t[0] if t[0] is not None else -1, len((t[1] or "").encode()) + 16, zlib.crc32((t[1] or "").encode())) for t in texts(docs))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in out) == want
    for s in range(4):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(docs.limit(0), 4).count() == 0


def test_sharding_balances_and_splits_only_large_groups(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(5, 60))) for i in range(1500)]
    rows += [(2000 + i, "small group of copies") for i in range(20)] + [(3000 + i, "copies of a third " * 3) for i in range(800)]
    out = sharding.shard(documents(spark, rows), 5)
    sums = [r.b for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 5 and max(sums) / min(sums) < 1.02, sums
    assert out.where("doc_id between 2000 and 2019").select("shard").distinct().count() == 1
    assert out.where("doc_id >= 3000").select("shard").distinct().count() > 1


def test_language(spark):
    rng = random.Random(3)
    tongues = {"xx": "abcde", "yy": "fghij", "zz": "klmno"}
    rows = [(i, words(rng, 30, tongues[k]), k) for i, k in enumerate(rng.choices(list(tongues), k=300))]
    table = spark.createDataFrame([*rows, (900, None, None), (901, "12 34", "xx"), (902, "abc " * 9000, "xx")], "doc_id long, text string, lang string")
    net = langid.fit(table)
    out = {r.doc_id: r for r in langid.predict(table, net).collect()}
    held = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(out[i].lang_pred == k for i, k in held) / len(held) > 0.97
    assert out[900].lang_pred == out[901].lang_pred == "und" and out[902].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in out.values())
    assert langid.fit(table.where("lang is null")) is None
    assert {r.lang_pred for r in langid.predict(table.limit(5), None).collect()} == {"und"}
    a = langid.predict(table.select("doc_id", "text"), net).collect()
    assert {r.doc_id: r.lang_pred for r in a} == {i: r.lang_pred for i, r in out.items()}  # no other column matters


def test_all_labels_are_learned(spark):
    rows = [(3 * i + k, chr(0x4E00 + 7 * i) * 40, f"l{i:02}") for i in range(70) for k in range(3)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    trained = {k for i, _, k in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert net.labels == sorted(trained) and len(trained) > 64


def test_language_stage_without_labels(spark):
    import corpus_pipeline

    rows = [(1, "some words", None), (2, None, None), (3, "12 34", None), (4, "other words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang) for r in corpus_pipeline.language(spark, docs, "").collect()} == {(1, "und"), (4, "und")}
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs.withColumn("lang", F.lit("und")), "").collect()} == {1, 4}


def brute_spans(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


SECRETS = [
    "password=hunter22x", "Token : 'abc.def-1'", "secret: token: abcdef", "API_KEY=\"zzzzzz\" x", "apikey=short", "é AKIA" + "A" * 16, "AKIA" + "B" * 15, "f" * 24, "a" * 23,
    "x" + "0123456789abcdef" * 3 + "g", "token=token=abcdefgh", "paſſword=abcdefgh", None, "", "plain words only", "tokentoken=a secret=bbbbbb\nsecret =cccccc", "passwd=" + "a" * 60_000,
]


def test_secrets_keep_the_base(spark):
    out = {r.doc_id: r for r in secrets.scan(documents(spark, list(enumerate(SECRETS)))).collect()}
    for i, t in enumerate(SECRETS):
        base = brute_spans(t or "")
        assert (out[i].n_assign, out[i].n_access, out[i].n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3)), t
        assert out[i].base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        assert set(secrets.joined(base).split(",")) <= set(out[i].spans.split(","))


def test_secrets_beyond_the_patterns():
    scanner = secrets.Scanner(*secrets.train())
    found = lambda t: [t[a:b] for a, k, b in scanner.spans(t) if k == 3]
    key = "Zx81kQpL0aRt5vWn3yUe7BcD"
    assert found(f"set auth_key = {key} before the run") == [key]
    assert found(f"Authorization: Bearer {key}") == [key]
    for clean in ("a plain line of words", "see https://example.org/some/path/to?page=2", "call 555-123-4567 on 2021-03-04", "mail to some.one@example.com"):
        assert found(clean) == [], clean


def test_redaction(spark):
    out = {r.doc_id: r.text for r in secrets.redact(documents(spark, [(1, "a password=hunter22x b"), (2, None), (3, "clean")])).collect()}
    assert out == {1: "a [SECRET] b", 2: None, 3: "clean"}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("threshold", [1, 2])
def test_lines(spark, threshold):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(40, 50))) for _ in range(20)]

    def changed(s):
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k = rng.randrange(len(s))
            s = rng.choice([s[:k] + "x" + s[k + 1 :], s[:k] + "yé" [rng.randrange(2)] + s[k:], s[:k] + s[k + 1 :]])
        return s

    rows = [(i, "\n".join(changed(rng.choice(base)) for _ in range(3))) for i in range(25)]
    rows += [(90, None), (91, ""), (92, "short\nshort\n--\n--"), (93, base[0] + "\n" + base[0]), (94, "z" * 20_000), (95, "shorT")]
    got = {(r.doc_id, r.line): (r.class_id, r.class_line, r.n_links) for r in line_dedup.duplicate_lines(documents(spark, rows), threshold=threshold).collect()}
    places = [((i, k), s) for i, t in rows for k, s in enumerate((t or "").split("\n")) if re.search(r"\w", s)]
    lines = sorted({s for _, s in places})
    root, degree = {s: s for s in lines}, dict.fromkeys(lines, 0)

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if min(len(a), len(b)) >= line_dedup.MIN_CHARS and abs(len(a) - len(b)) <= threshold and edit_distance(a, b) <= threshold:
                degree[a], degree[b] = degree[a] + 1, degree[b] + 1
                root[find(a)] = find(b)
    classes = {}
    for p, s in places:
        classes.setdefault(find(s), []).append((p, s))
    assert got == {p: (*min(q for q, _ in v), degree[s]) for v in classes.values() if len(v) > 1 for p, s in v}
    kept = {r.doc_id: r.text for r in line_dedup.without_duplicate_lines(documents(spark, rows), threshold=threshold).collect()}
    for i, t in rows:
        want = None if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if got.get((i, k), (i, k))[:2] == (i, k))
        assert kept[i] == want


def test_lines_of_a_hot_group_of_near_copies(spark):
    rng = random.Random(21)
    lines = {"".join(rng.choice("abcdefgh ") for _ in range(90))}
    base = min(lines)
    while len(lines) < 300:
        s = rng.choice(sorted(lines)) if rng.random() < 0.6 else base
        k = rng.randrange(len(s))
        lines.add(rng.choice([s[:k] + rng.choice("xyz") + s[k + 1 :], s[:k] + rng.choice("xyé") + s[k:], s[:k] + s[k + 1 :], s[:k] + "".join(rng.choices("mnop", k=6)) + s[k + 6 :]]))
    lines = sorted(lines)
    rows = list(enumerate(lines)) + [(1000 + i, "\n".join(rng.choices(lines, k=4))) for i in range(60)]
    got = {(r.doc_id, r.line): r for r in line_dedup.duplicate_lines(documents(spark, rows)).collect()}
    near = {(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if abs(len(a) - len(b)) <= 1 and edit_distance(a, b) <= 1}
    degree = {s: sum(s in p for p in near) for s in lines}
    assert max(degree.values()) > 4 * line_dedup.HOT
    component = components_of(lines, near)
    first = {}
    for i, t in sorted(rows):
        for k, s in enumerate(t.split("\n")):
            first.setdefault(component[s], (i, k))
    for i, t in rows:
        for k, s in enumerate(t.split("\n")):
            r = got.get((i, k))
            assert (r.n_links if r else 0) == degree[s]
            assert not r or (r.class_id, r.class_line) == first[component[s]]


@pytest.mark.parametrize("most", [line_dedup.MOST_BUCKETS, 1])
def test_a_filter_loses_no_row(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "MOST_BUCKETS", most)
    rows = spark.range(100_000).selectExpr("id * 7 as h1", "-id as h2")
    wanted = rows.where("h1 % 10 = 3")
    left = line_dedup.maybe_in(rows, wanted, ["h1", "h2"])
    assert left.columns == rows.columns and left.join(wanted, ["h1", "h2"], "left_semi").count() == wanted.count()
    assert left.count() < (30_000 if most > 1 else 50_000)
    assert line_dedup.maybe_in(rows, wanted.limit(0), ["h1", "h2"]).count() == 0


def test_lines_of_repeated_and_null_ids(spark):
    a, b = "a line that stands in more than one document", "a line that is nowhere else in this table"
    rows = [(1, a), (7, "short\n" + a), (7, "short\n" + b), (None, a + "\nown"), (None, "own"), (9, None)]
    table = documents(spark, rows).withColumns({"__id": F.lit("x"), "__removed": F.lit(1), "row": F.lit(2)})
    out = line_dedup.without_duplicate_lines(table)
    assert out.columns == table.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=key)
    # Null ids come first, of texts the one of the smaller hash.
    assert [t for i, t in kept if i == 1] == [""] and [t for i, t in kept if i == 9] == [None]
    everything = "\n".join(t for _, t in kept if t).split("\n")
    assert sorted(x for x in everything if x) == sorted([a, b, "own", "short"])
    assert line_dedup.duplicate_lines(table.limit(0)).count() == 0 and line_dedup.without_duplicate_lines(table.limit(0)).count() == 0


BIG = 2**53 + 1


def test_ids_beyond_double_precision_beside_nulls(spark):
    rows = [(BIG, "some words of a text with a password=hunter22x here"), (None, "other words"), (BIG + 1, None), (BIG, "")]
    table = documents(spark, rows).coalesce(1)
    want = sorted([BIG, BIG + 1, BIG, -1])
    ids = lambda df, c="doc_id": sorted(-1 if r[c] is None else r[c] for r in df.select(c).collect())
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert ids(secrets.scan(table)) == want
    assert ids(packing.pack(table, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))) == want
    assert ids(simhash.near_duplicates(table)) == want and ids(simhash.similar_documents(table)) == want
    assert ids(bpe_codec.digests(table, path, public_tokenizers.PATTERN)) == want
    assert ids(sharding.shard(table, 2)) == want
    assert ids(langid.predict(table.withColumn("__text", F.lit(1)), None)) == want
    vectors = spark.createDataFrame([(BIG, [1.0, 0.0]), (None, [1.0, 0.1]), (BIG + 1, None), (BIG, [0.0, 1.0])], "vec_id long, embedding array<double>").coalesce(1)
    assert ids(vector_dedup.link_vectors(vectors), "vec_id") == want
    found = ann.search(vectors, lambda i: i == BIG).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [(BIG, 1, BIG, 0.0), (BIG, 1, BIG, 0.0)]


def test_bpe(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.rank_file(path), special_tokens={})
    out = {(r.doc_id, r.ids_sha256): r for r in bpe_codec.digests(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t in texts(docs):
        if i == 102:  # one word of 50,000 letters: the library's own time there is quadratic
            continue
        ids = coder.encode_ordinary(t or "")
        r = out[i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()]
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    rng, ranks = random.Random(5), bpe.rank_file(path)
    assert bpe_codec.encode(docs.limit(0), "doc_id", "text", path, public_tokenizers.PATTERN).count() == 0
    back = bpe_codec.decode(bpe_codec.encode(docs, "doc_id", "text", path, public_tokenizers.PATTERN), path).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in texts(docs))
    for _ in range(200):
        piece = bytes(rng.choices(b"abtheingtion \n\xc3\xa9", k=rng.randint(1, 200)))
        assert bpe.merge(piece, ranks) == coder._encode_single_piece(piece)


def test_splitter_is_the_pattern():
    import public_tokenizers
    import regex

    split, whole = bpe_codec.splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    fast = bpe_codec.narrow(public_tokenizers.PATTERN).findall
    rng = random.Random(23)
    every = [chr(c) for c in range(1 << 16)]
    assert fast("".join(every)) == whole("".join(every)) and all(fast(f" {c}a{c}1 ") == whole(f" {c}a{c}1 ") for c in every)
    for kind in ("aZ09 '\n\t\x1c\x85-.sltrevmd", "aäßж中٣²½ \u2003\u00a0'\n_s", "a😀𝐀𝟗 \n'ß\U0001f1e9"):
        for _ in range(500):
            text = "".join(rng.choices(kind, k=40))
            assert split(text) == whole(text)


def test_nearest(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, 24)).astype(np.float32)
    x[10:60] = x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, [0.0] * 24), (940, [float("nan")] * 24), (960, [None] * 24), (3, x[3].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(table, lambda i: i % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 800, 20))
    d, hits = x.astype(float), 0
    for q, found in got.items():
        score = d @ d[q]
        order = [i for i in np.lexsort((np.arange(800), -score)) if i != q][:20]
        hits += len({found[k][0] for k in found} & set(order))
        assert sorted(found) == list(range(1, 21)) and all(abs(score[v] - s) < 1e-9 for v, s in found.values())
    assert hits / (20 * len(got)) >= 0.9
    assert ann.search(table.limit(0), lambda i: i % 20 == 0).count() == 0


def test_nearest_in_a_group_of_near_copies(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(size=(9000, 32))
    x[3000:] = x[0] + rng.normal(size=(6000, 32)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(table, lambda i: i % 60 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert len(got) == 150
    for q, found in got.items():
        score = x @ x[q]
        assert [found[k] for k in range(1, 21)] == [i for i in np.argsort(-score) if i != q][:20]


def test_nearest_of_other_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(26)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(500)] + [(i % 7, rng.normal(size=8).tolist()) for i in range(40)]
    rows += [(i, rng.normal(size=5).tolist()) for i in range(600, 650)] + [(20, rng.normal(size=5).tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(table, lambda i: i % 20 == 0).collect())
    want = []
    for k, (i, v) in enumerate(rows):
        if i % 20 == 0:
            near = sorted((-float(np.dot(v, w)), j) for m, (j, w) in enumerate(rows) if m != k and len(w) == len(v))[:20]
            want += [(i, n, j, round(-s, 9)) for n, (s, j) in enumerate(near, 1)]
    assert got == sorted(want)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    table = docs.unionByName(documents(spark, [(700, "a <|endoftext|> b"), (701, words(random.Random(7), 4000))])).where("doc_id is not null").dropDuplicates(["doc_id"])
    out = packing.pack(table.coalesce(1), "doc_id", "text", path).collect()
    tokens = Tokenizer.from_file(path)
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in texts(table):
        ids = np.array([*tokens.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc.pop(i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    padding = sum(0 if (n := sum(r.length for r in p)) & (n - 1) == 0 else 2048 - n for p in by_sequence.values())
    assert padding <= 2048
    assert packing.pack(table.limit(0), "doc_id", "text", path).count() == 0


def components_of(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([*links, (None, 3)], "a long, b long"), "a", "b").collect()}
    want = components_of({n for p in links for n in p}, links)
    assert got == {n: c for n, c in want.items() if n != c}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_joins_with_hot_keys(spark, monkeypatch):
    left = spark.createDataFrame([(k, i) for k, n in ((1, 30), (2, 9), (3, 2), (4, 1)) for i in range(n)], "k long, i long")
    right = spark.createDataFrame([(1, 30, "a"), (2, 9, "b"), (3, 2, "c"), (5, 0, "d")], "k long, n long, v string")
    want = sorted(map(tuple, left.join(right.drop("n"), "k").collect()))
    for most in (1, 5, 100):
        monkeypatch.setattr(common, "HOT_ROWS", most)
        got = common.join_hot(left, right, ["k"], "n")
        assert got.columns == ["k", "i", "v"]
        assert sorted(map(tuple, got.collect())) == want
    assert common.join_hot(left, right.limit(0), ["k"], "n").count() == 0


def test_operators_give_the_same_whatever_is_hot(spark, docs, monkeypatch):
    rows = docs.union(documents(spark, [(200 + i, "the same line of a text\nand one more line of it") for i in range(20)] + [(300, "the same line of a texts")]))
    links = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(90, i) for i in range(60, 90)] + [(i, i + 1) for i in range(200, 230)], "a long, b long")
    rng = np.random.default_rng(4)
    x = np.concatenate([np.ones((30, 8)), np.ones((30, 8)) + rng.normal(size=(30, 8)) * 0.05, rng.normal(size=(20, 8))])
    vectors = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (500, None), (501, None)], "vec_id long, embedding array<double>")

    def run():
        made = (graph.components(links, "a", "b"), simhash.near_duplicates(rows), line_dedup.duplicate_lines(rows), vector_dedup.link_vectors(vectors))
        return [sorted(map(repr, df.collect())) for df in made]

    plain = run()
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert run() == plain


def test_vector_dedup(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 16))
    x[50:80] = x[50] + rng.normal(size=(30, 16)) * 0.03
    x[100:110] = x[99] * 2
    x[120:125] = x[119]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("inf")] * 16), (903, [])]
    table = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, component_id int")
    got = {r.vec_id: r for r in vector_dedup.link_vectors(table).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(a, b) for a, b in zip(*np.nonzero(unit @ unit.T >= 0.95), strict=True) if a != b]
    want = components_of(range(300), links)
    assert {i: r.component_id for i, r in got.items()} == want | {i: i for i in (900, 901, 902, 903)}
    assert sum(r.n_links for r in got.values()) >= 0.95 * len(links)
    assert all(got[i].n_links <= sum(a == i for a, _ in links) for i in range(300))
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert vector_dedup.link_vectors(table.limit(0)).count() == 0


def test_links_of_a_group_far_wider_than_the_window(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(7000, 32))
    x[:6000] = x[0] + rng.normal(size=(6000, 32)) * rng.uniform(0.1, 0.35, (6000, 1))
    x[6100] = x[6101] * 3
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vector_dedup.link_vectors(table).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    want = near.sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(7000)])
    assert want.max() > 4 * vector_dedup.WINDOW and (found <= want).all()
    assert found.sum() >= 0.999 * want.sum(), found.sum() / want.sum()
    root = vector_dedup.roots(*np.nonzero(near), 7000)
    assert sum(got[i].component_id == root[i] for i in range(7000)) >= 0.999 * 7000
    assert vector_dedup.passes_for(10**8, 0.95, 512) > vector_dedup.passes_for(10**6, 0.95, 512) > vector_dedup.PASSES


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(parts[i : i + 3]) for i in range(max(1, len(parts) - 2))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs):
    out = simhash.near_duplicates(docs.where("doc_id is not null")).collect()
    want = {i: brute_fingerprint(t) for i, t in texts(docs) if i is not None}
    assert {r.doc_id: r.fingerprint & (1 << 64) - 1 for r in out} == want
    links = [(a, b) for a in want for b in want if a < b and (want[a] ^ want[b]).bit_count() <= 2]
    assert {r.doc_id: r.component_id for r in out} == components_of(want, links)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs).count() == docs.count()  # a null id stays


def test_similar_documents(spark):
    rng = random.Random(32)
    alphabet = "abcdefghijklmnop"
    rows, n = [], 0
    for _ in range(25):
        own = words(rng, 200, alphabet).split()
        rows.append((n, " ".join(own)))
        for share in (0.01, 0.02, 0.12):  # similarities of about 0.9, 0.82 and 0.35
            rows.append((n + 1, " ".join("changed" + str(rng.random()) if rng.random() < share else w for w in own)))
            n += 1
        n += 1
    rows += [(900, None), (901, ""), (902, "few words"), (903, "Few  WORDS"), (904, "other words")]
    out = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(spark, rows)).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [(t or "").lower().split()]}
    near = []
    for i in sets:
        for j in sets:
            similarity = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            assert out[i] != out[j] or similarity > 0.6
            near += [out[i] == out[j]] if i < j and similarity >= 0.8 else []
    assert len(near) > 40 and sum(near) / len(near) >= 0.95
    assert simhash.similar_documents(documents(spark, rows).limit(0)).count() == 0


def test_joined_rows_by_parts_of_a_bucket():
    rng = np.random.default_rng(33)
    prints = rng.integers(0, 2**63, (400, 4)).astype(np.uint64)
    prints[100:180] = prints[100] ^ (np.uint64(1) << rng.integers(0, 63, (80, 4)).astype(np.uint64))
    buckets = np.sort(rng.integers(0, 30, 400))
    buckets[90:200] = buckets[90]
    buckets.sort()
    for side in (np.full(400, 2), rng.integers(0, 2, 400)):
        a, b = simhash.joined_rows(prints, buckets, side, 20)
        links = [
            (i, j) for i in range(400) for j in range(i + 1, 400)
            if buckets[i] == buckets[j] and (side[i] == 2 or side[i] != side[j]) and int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= 20
        ]
        want = components_of(range(400), links)
        assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {i: c for i, c in want.items() if i != c}


def test_one_document_of_each_component_stays(spark):
    rng = random.Random(31)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(1, a), (2, a), (None, a), (None, b), (None, b), (None, c), (5, d), (5, d), (5, words(rng, 60)), (4, d), (6, None), (7, ""), (8, " \n")]
    table = documents(spark, rows)
    out = simhash.without_near_duplicates(table)
    assert out.columns == table.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted([(1, a), (None, b), (None, c), (4, d), rows[8], (6, None)], key=key)
    assert simhash.without_near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize(("radius", "segments"), [(2, 2), (3, 2), (1, 2), (3, 4)])
def test_close_pairs(spark, radius, segments):
    rng = random.Random(10)
    values = {rng.getrandbits(64) - (1 << 63) for _ in range(60)}
    for v in list(values):
        u = v
        for b in rng.sample(range(63), rng.randint(0, 4)):
            u ^= 1 << b
        values.add(u)
    got = {(r.a, r.b) for r in simhash.close_pairs(spark.createDataFrame([(v,) for v in values], "fingerprint long"), radius, segments).collect()}
    assert got == {(a, b) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}


def test_passages(spark):
    rng = random.Random(11)
    alphabet = "abcdefghijklmnop"
    passage = words(rng, 80, alphabet).split()
    fuzzy = [w if i % 17 else "changed" for i, w in enumerate(passage)]
    filler = lambda n: words(rng, n, alphabet).split()
    rows = [(1, filler(90) + passage + filler(40)), (2, filler(30) + fuzzy + filler(60)), (3, passage), (4, filler(200)), (5, passage[:30] + filler(100))]
    rows = [(i, " ".join(t)) for i, t in rows] + [(6, None), (7, ""), (8, "same " * 3000), (9, "few words")]
    out = {(r.doc_id, r.source_doc_id): r for r in chaining.passages(documents(spark, rows)).collect()}
    assert set(out) == {(2, 1), (3, 1)}
    assert (out[3, 1].start_word, out[3, 1].end_word, out[3, 1].source_start) == (0, 80, 90) and out[3, 1].edits == 0
    assert out[2, 1].end_word - out[2, 1].start_word >= 70 and out[2, 1].similarity > 0.9
    assert chaining.passages(documents(spark, rows).limit(0)).count() == 0


def test_passages_of_a_hot_source(spark):
    rng = random.Random(14)
    passage = words(rng, 80, "abcdefghijklmnop")
    rows = [(i, f"{words(rng, i % 7, 'qrst')} {passage}".strip()) for i in range(2 * chaining.HOT_LINKS)]
    out = chaining.passages(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in out) == list(range(1, len(rows))) and {r.source_doc_id for r in out} == {0}
    assert all(r.similarity == 1 and r.end_word - r.start_word == 80 for r in out)
    links = spark.createDataFrame([(i, 1, 0 if i < 200 else 1, 1) for i in range(210)], "doc long, row long, source long, source_row long")
    slotted, slots = chaining.dealt(links)
    sizes = {(r.source, r.slot): r["count"] for r in slotted.groupBy("source", "slot").count().collect()}
    assert sum(sizes.values()) == 210 and sizes[1, 0] == 10 and max(n for (s, _), n in sizes.items() if s == 0) < 20
    assert {(r.source, r.slot) for r in slots.collect()} == set(sizes)


def test_passages_whose_seeds_have_different_first_holders(spark):
    rng = random.Random(17)
    filler = lambda n: words(rng, n, "qrstuv").split()
    rows = []
    for i in range(0, 400, 10):
        p = words(rng, 90, "abcdefghijklmnop").split()
        rows += [(i + 1, filler(9) + p[:45] + filler(20)), (i + 2, filler(30) + p[45:]), (i + 5, filler(12) + p + filler(7))]
        rows += [(i + 9, filler(70) + p + filler(40) + p)]  # the second time, too
    out = chaining.passages(documents(spark, [(i, " ".join(t)) for i, t in rows])).collect()
    found = {(r.doc_id, r.source_doc_id, r.start_word) for r in out if r.end_word - r.start_word == 90 and r.edits == 0}
    assert found == {(i + 9, i + 5, at) for i in range(0, 400, 10) for at in (70, 200)} and len(out) == len(found)


@pytest.mark.parametrize("hot_seed", [1, 16])
def test_passages_with_any_earlier_document(spark, hot_seed):
    """Overlapping parts of p have nearer holders at both ends of the order, singly and frequently; one document between has p as a whole."""
    rng = random.Random(19)
    filler = lambda n: words(rng, n, "qrstuv").split()
    rows, expected = [], set()
    for i in range(0, 1000, 100):
        p = words(rng, 105, "abcdefghijklmnop").split()
        part = lambda k, p=p: filler(20) + p[20 * k : 20 * k + 45] + filler(20)
        rows += [(i + k, part(k % 4)) for k in range(30)] + [(i + 30, filler(12) + p + filler(9))]
        rows += [(i + 31 + k, part(k % 4)) for k in range(30)] + [(i + 70, filler(25) + p + filler(14))]
        expected.add((i + 70, i + 30, 25, 130))
    out = chaining.passages(documents(spark, [(i, " ".join(t)) for i, t in rows]), hot_seed=hot_seed).collect()
    assert {(r.doc_id, r.source_doc_id, r.start_word, r.end_word) for r in out} == expected and len(out) == len(expected)


def test_hot_seeds_lose_no_passage(spark):
    rng = random.Random(20)
    pool = [words(rng, 60, "abcdefghijklmnop").split() for _ in range(4)]
    rows = []
    for i in range(60):
        t = []
        for p in rng.sample(pool, rng.randint(1, 3)):
            t += words(rng, rng.randint(0, 30), "qrstuv").split() + [w if rng.random() > 0.03 else f"x{i}" for w in p]
        rows.append((i, " ".join(t)))
    every, few = (chaining.passages(documents(spark, rows), hot_seed=n).collect() for n in (1 << 30, 4))
    beyond = 2 * chaining.K  # words past the last shared seed
    within = lambda r, q: q.doc_id == r.doc_id and q.source_doc_id <= r.source_doc_id and q.start_word - beyond < r.start_word and r.end_word < q.end_word + beyond
    assert len(every) > 50 and all(any(within(r, q) for q in few) for r in every)


def test_passages_free_their_shuffle_files(spark):
    rng = random.Random(22)
    passage = words(rng, 80, "abcdefghijklmnop")
    rows = [(i, f"{words(rng, 9 + i, 'qrst')} {passage}") for i in range(40)]
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for top in disk.localDirs() for _, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_")}
    before = files()
    out = chaining.passages(documents(spark, rows))
    for _ in range(50):  # they go in the background
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 39


def test_join_hot_frees_its_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for top in disk.localDirs() for _, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_")}
    left, right = spark.range(9), common.cut(spark.range(9).selectExpr("id", "1L as n"))
    before = files()
    out = common.join_hot(left, right, ["id"], "n")
    for _ in range(50):  # they go in the background
        if not (more := files() - before):
            break
        time.sleep(0.1)
    assert not more and out.count() == 9


def test_passages_of_copies(spark):
    """Copies of a document have its passages and the whole text, unless a smaller source has that."""
    rng = random.Random(23)
    p, q, r = (words(rng, 90, "abcdefghijklmnop") for _ in range(3))
    rows = [(1, p), (2, f"{p} {q}"), (3, r), (4, f"{r} end"), (5, "short text")]
    rows += [(i, rows[k][1]) for i, k in zip(range(10, 40), [1, 2, 3, 4] * 9, strict=False)]
    out = chaining.passages(documents(spark, [*rows, rows[7], rows[8]])).collect()
    got = sorted((x.doc_id, x.start_word, x.end_word, x.source_doc_id, x.source_start, x.source_end, x.edits) for x in out)
    expected = [(2, 0, 90, 1, 0, 90, 0), (4, 0, 90, 3, 0, 90, 0)]
    for i, text in rows[5:]:
        if text == rows[1][1]:
            expected += [(i, 0, 90, 1, 0, 90, 0), (i, 0, 180, 2, 0, 180, 0)]
        elif text in (r, f"{r} end"):
            expected.append((i, 0, 90, 3, 0, 90, 0))
    assert got == sorted(expected)


def test_a_far_seed_loses_no_passage(spark):
    rng = random.Random(24)
    p, far = words(rng, 600, "abcdefghijklmnop"), words(rng, 40, "abcdefghijklmnop")
    rows = [(i, f"{p} {words(rng, 900, 'qrstuv')} {far}") for i in (1, 2)]
    out = chaining.passages(documents(spark, rows)).collect()
    assert [(x.doc_id, x.start_word, x.end_word, x.source_doc_id, x.edits) for x in out] == [(2, 0, 600, 1, 0)]


def test_bytes_never_make_a_reach_shorter():
    rng = np.random.default_rng(21)
    for _ in range(300):
        x = rng.integers(0, 40, 46)
        y = np.where(rng.random(46) < 0.8, x, rng.integers(0, 40, 46))
        exact, fewer = chaining.reach(x, y)[0], chaining.reach_bound((x % 30)[None], (y % 30)[None])[0]
        assert fewer >= exact


def test_chain_is_the_best():
    rng = random.Random(12)
    for _ in range(30):
        points = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(8)})
        a, b = np.array([p[0] for p in points]), np.array([p[1] for p in points])
        best = {}
        for i, (p, q) in enumerate(points):
            before = [best[j] - chaining.GAP_COST * (p + q - sum(points[j])) for j in range(i) if points[j][0] < p and points[j][1] < q]
            best[i] = chaining.K + max([0, *before])
        own = chaining.chain(a, b)[0]
        score = chaining.K * len(own) - chaining.GAP_COST * (a[own[-1]] + b[own[-1]] - a[own[0]] - b[own[0]])
        assert abs(score - max(best.values())) < 1e-9
        assert chaining.edits(np.array([1, 2, 3]), np.array([1, 3])) == 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    rows = [(i, words(rng, 60), "xx" if i % 2 else "yy", "s", 1) for i in range(40)]
    rows += [(50, None, "xx", "s", 0), (51, "12 34", "xx", "s", 1), (52, rows[0][1], "xx", "s", 1), (53, words(rng, 30) + " password=hunter22x", None, "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {50, 51} and kept.columns == docs.columns
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} >= set(range(1, 40)) | {0} and {50, 51}.isdisjoint({r.doc_id for r in final})


def test_pipeline_packs_each_language_by_itself(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(22)
    alphabets = {"xx": "abcdefgh", "yy": "stuvwxyz"}
    truth = {i: "xx" if i % 2 else "yy" for i in range(120)}
    rows = [(i, words(rng, 60, alphabets[lang]), lang if i < 80 else None, "s", 1) for i, lang in truth.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.lang for r in final} == truth
    by_sequence = {}
    for r in final:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        assert len({r.lang for r in pieces}) == 1
        ends = sorted((r.offset, r.length) for r in pieces)
        assert [o for o, _ in ends] == [sum(n for _, n in ends[:k]) for k in range(len(ends))] and sum(n for _, n in ends) <= 2048
    assert all(sum(r.length for r in final if r.doc_id == i) == next(r.doc_tokens for r in final if r.doc_id == i) for i in truth)
