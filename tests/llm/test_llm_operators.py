"""Every operator against a plain version, on odd cases: nulls, empty and long texts, repeated rows, clashing columns."""

import pickle
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from navella.llm import edit_counts, id_files, jaccard_join, media, nearest, packing, quality, toxicity, url_filter, word_trie
from navella.llm.tokens import TextEncoder, vocabulary

BYTES, WORDS, PIECES = (vocabulary(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def odd_texts() -> list:
    rng = random.Random(1)
    fixed = [None, "", " ", "  a  b\n\n c \t d", "it's 'll don't  . , x", "日本 語 text", "<|endoftext|> a", "\n\nx\n", "Σας ΣΑΣ", "a.b.c 12.5", "x\x0bz \x1c y", "a▁b ▁ c", "long word " * 4000, "same text here", "same text here"]
    return fixed + ["".join(rng.choice("ab'st .,\n\t é　日1!-") for _ in range(rng.randint(0, 80))) for _ in range(150)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else i, t, "s", 5, 0.5) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens long, score double").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def reference(path, texts):
    return [e.ids for e in TextEncoder.of(path).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_the_librarys(path):
    texts = odd_texts()
    got = TextEncoder.of(path).encode_each(pa.array(texts))
    assert [list(x) for x in got] == reference(path, texts)


def test_id_files(spark, docs):
    rows = {(r["doc_id"], r["n_tokens"], r["ids_crc32"]): r["start"] for r in id_files.read_id_files(id_files.write_id_files(docs, WORDS, 1)).collect()}
    order = sorted(((-1 if i == 3 else i), t or "", i) for i, t in enumerate(odd_texts()))
    ids, at = reference(WORDS, [t for _, t, _ in order]), 0
    for (_, _, i), x in zip(order, ids, strict=True):
        assert rows[(None if i == 3 else i, len(x) + 1, crc(x + [1]))] >= 0
        if i not in (13, 14):
            assert rows[(None if i == 3 else i, len(x) + 1, crc(x + [1]))] == at
        at += len(x) + 1
    assert id_files.read_id_files(id_files.write_id_files(empty(spark), WORDS, 1)).count() == 0


def test_rans_round_trip_and_checksums():
    rng = np.random.default_rng(2)
    for n in (1, 5, 2048, 2049, 300_000):
        ids = np.minimum(rng.zipf(1.3, n), 49_000).astype(np.uint16)
        table = id_files.Table(id_files.frequencies(np.bincount(ids)))
        raw = id_files.write_block(np.array([7]), np.array([n]), ids, table)
        assert (id_files.read_block(raw, table)[2] == ids).all()
        with pytest.raises(ValueError, match="checksum"):
            id_files.read_block(raw[:-2] + bytes([raw[-2] ^ 1, raw[-1]]), table)


def test_packing(spark, docs):
    got = packing.pack(docs, BYTES, 0, 64).collect()
    texts = odd_texts()
    ids = reference(BYTES, texts)
    bins, seen = defaultdict(list), defaultdict(int)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        i = 3 if r["doc_id"] is None else r["doc_id"]
        assert r["ids_crc32"] == crc((ids[i] + [0])[r["start"] : r["start"] + r["length"]])
        seen[i] += r["length"]
    assert {i: len(x) + 1 for i, x in enumerate(ids)} == seen
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(seen.values())
    assert len(bins) <= 1.05 * total / 64 + 2
    assert packing.pack(empty(spark), BYTES, 0).count() == 0


def test_plan_is_near_the_bound_and_whole():
    rng = np.random.default_rng(0)
    counts = np.bincount(np.minimum(rng.geometric(0.004, 20_000), 2048), minlength=2049)
    rows, n = packing.plan(counts, 2048)
    assert (np.bincount(rows[:, 0], rows[:, 2], 2049) == counts).all()
    assert n <= 1.01 * (counts * np.arange(2049)).sum() / 2048 + 1


def test_edits(spark, docs):
    edits = F.array(*(edit_counts.edit(F.lit(a), F.lit(b), F.lit(t)) for a, b, t in ((3, 5, "é x"), (0, 1, ""), (10**6, 10**6, " end."), (2, 2, "\n"))))
    made = edit_counts.apply_edits(edit_counts.token_trees(docs.withColumn("edits", edits), BYTES), BYTES).collect()
    assert len(made) == docs.count()
    for r in made:
        t = odd_texts()[3 if r["doc_id"] is None else r["doc_id"]] or ""
        for a, b, new in ((3, 5, "é x"), (0, 1, ""), (10**6, 10**6, " end."), (2, 2, "\n")):
            t = t[: min(a, len(t))] + new + t[max(min(a, len(t)), min(b, len(t))) :]
        assert r["text"] == t
        assert r["n_tokens"] == len(reference(BYTES, [t])[0]) == sum(r["tree_tokens"])
    assert edit_counts.token_trees(empty(spark), BYTES).count() == 0


def test_pieces(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in word_trie.decode_pieces(word_trie.digests(word_trie.encode_pieces(docs, PIECES)), PIECES).collect():
        text = odd_texts()[3 if r["doc_id"] is None else r["doc_id"]] or ""
        assert r["ids"] == model.encode(text)
        assert r["decoded"] == text.replace("▁", " ")
        assert (r["n_pieces"], r["ids_crc32"]) == (len(r["ids"]), crc(r["ids"]))


def test_media(spark, docs, tmp_path):
    import hashlib

    path = media.store_texts(docs, f"file://{tmp_path}/m")
    for r in media.describe(media.read_media(spark, path)).collect():
        raw = (odd_texts()[3 if r["doc_id"] is None else r["doc_id"]] or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert media.read_media(spark, media.store_texts(empty(spark), f"file://{tmp_path}/e")).count() == 0


def test_damaged_member_is_retried():
    class Source:
        def __init__(self, raw):
            self.raw, self.reads = raw, 0

        def read_at(self, n, at):
            self.reads += 1
            return self.raw[at : at + n] if self.reads > 2 else self.raw[at : at + n - 1]

    png = media.png_of(media.payload_of("abc"))
    raw = media._MEMBER.pack(4, 3, len(png), zlib.crc32(png), False) + png
    assert media.read_member(Source(raw), "a", 0) == (4, 3, png)


def near_corpus() -> dict:
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    out, n = {}, 0
    for size in (3, 6, 12, 30, 80, 200, 600):
        for _ in range(6):
            base = [rng.choice(words) for _ in range(size)]
            for copy in range(5):
                t = list(base)
                for _ in range(rng.randint(0, max(1, size // 40)) if copy else 0):
                    t[rng.randrange(size)] = rng.choice(words)
                out[n] = " ".join(t).upper() if copy == 4 else " ".join(t)
                n += 1
    shared = " ".join(rng.choice(words) for _ in range(60))
    for k in range(40):
        out[n + k] = shared + " " + " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))
    return out | {900: None, 901: "", 902: " \t", 903: "one", 904: "ONE"}


def plain_components(texts: dict) -> dict:
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in texts}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in texts}


@pytest.mark.parametrize("large", [2048, 3])
def test_components(spark, monkeypatch, large):
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    texts = near_corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, label int").repartition(4)
    want = plain_components(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.component_ids(df).collect()} == want
    kept = {r["doc_id"] for r in jaccard_join.first_of_each(df).collect()}
    assert kept == {c for _, c in want.values()}


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for s in [*range(1, 60), 100, 400, 1500] * 3:
        a = np.unique(rng.integers(0, 2**64, s, dtype=np.uint64))
        x = int(rng.integers(0, s // 5 + 1))
        y = max((k for k in range(s // 4 + 1) if 100 * (s - x) >= 80 * (s + k)), default=0)
        b = np.unique(np.concatenate([rng.permutation(a)[x:], rng.integers(0, 2**64, y, dtype=np.uint64)]))
        if jaccard_join.similar(a, b):
            assert all(len(np.intersect1d(jaccard_join.signatures(a, k), jaccard_join.signatures(b, k))) for k in (0, 1))
            assert 9 * sum(bin((p ^ q) & (1 << 64) - 1).count("1") for p, q in zip(jaccard_join.sketch_of(a), jaccard_join.sketch_of(b), strict=True)) <= len(a) + len(b)


def test_empty_corpus_has_no_components(spark):
    assert jaccard_join.component_ids(empty(spark)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(600, None, 1), (601, [0.0] * 8, 1), (602, [float("nan")] * 8, 1), (603, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in nearest.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 600, 20))
    y, hit = x.astype(np.float64), 0
    for q, found in got.items():
        order = sorted((i for i in range(600) if i != q), key=lambda i: (-float(nearest.exact(y[q : q + 1], y[i : i + 1])[0]), i))[:20]
        hit += len(set(order) & {i for i, _ in found})
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hit / (20 * len(got)) >= 0.9
    assert nearest.search(df.limit(0), F.lit(True), 20).count() == 0


def test_leaves_are_split_where_they_are_large(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SAMPLE_ROWS", 100)
    monkeypatch.setattr(nearest, "SPLIT_ROWS", 100)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8)) * 3
    x = centres[rng.integers(0, 40, 1600)] + rng.normal(size=(1600, 8)) * 0.2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    upper = nearest.Tree.fit(x[:100])
    whole = nearest.with_subtrees(df, upper, 8)
    assert whole.leaves > 2 * upper.leaves
    leaf = whole.assign(x)
    assert leaf.min() >= 0 and np.bincount(leaf, minlength=whole.leaves).max() <= 200
    assert sorted(whole.visit(x[0], whole.leaves)) == list(range(whole.leaves))
    got = nearest.search(df, F.col("vec_id") % 20 == 0, 20).collect()
    hit, scores = 0, x @ x.T
    for r in got:
        assert r["score"] == float(nearest.exact(x[r["query_id"]][None], x[r["vec_id"]][None])[0])
    for q in range(0, 1600, 20):
        order = sorted((i for i in range(1600) if i != q), key=lambda i: -scores[q, i])[:20]
        hit += len(set(order) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hit / (20 * 80) >= 0.9


def test_walks_of_many_queries_are_those_of_the_queue():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 8))
    x[2000:] = x[:1000].round(0)  # equal products, too
    tree = nearest.Tree.fit(x, least=8)
    levels = tree.levels()
    for number in (1, 7, tree.leaves // 3, tree.leaves - 1, tree.leaves, 2 * tree.leaves):
        got = tree.visited(x[:40], number, levels)
        for q, row in zip(x[:40], got, strict=True):
            assert row.sum() == min(number, tree.leaves)
            assert set(np.flatnonzero(row)) == set(tree.visit(q, number))


def test_a_query_meets_a_run_of_leaves_once(spark, monkeypatch):
    """Not once for each leaf: what is dealt to the comparing tasks grew with queries times leaves."""
    seen = {}

    def stored(df, name, keep=nearest.stored):
        table = keep(df, name)
        seen[name] = table.count()
        return table

    monkeypatch.setattr(nearest, "stored", stored)
    x = np.random.default_rng(9).normal(size=(2000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    whole = nearest.search(df, F.col("vec_id") % 20 == 0, 20).collect()
    assert seen["visits"] == 100
    monkeypatch.setattr(nearest, "BLOCK", 300)  # runs of some leaves, and more blocks of queries
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 30)
    assert sorted(nearest.search(df, F.col("vec_id") % 20 == 0, 20).collect()) == sorted(whole)
    monkeypatch.setattr(nearest, "BLOCK", 20)  # leaves in parts
    assert sorted(nearest.search(df, F.col("vec_id") % 20 == 0, 20).collect()) == sorted(whole)


def test_double_vectors_keep_their_scores(spark):
    rows = [(0, [1e-9, 1.0]), (1, [0.05000000002, 0.0]), (2, [1e-50, 0.0]), (3, [0.0, 0.0])]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 1, 20).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(0, 0.05000000002 * 1e-9), (2, 0.05000000002 * 1e-50)]


def plain_ranks(edges, allowed, blocked, hosts):
    out, into = defaultdict(int), defaultdict(int)
    for (a, b), n in edges.items():
        out[a] += n
        into[b] += n
    trust, distrust = dict(allowed), dict(blocked)
    for _ in range(300):
        trust = {h: 0.15 * allowed.get(h, 0) + 0.85 * sum(trust.get(a, 0) * n / out[a] for (a, b), n in edges.items() if b == h) for h in hosts}
        distrust = {h: 0.15 * blocked.get(h, 0) + 0.85 * sum(distrust.get(b, 0) * n / into[b] for (a, b), n in edges.items() if a == h) for h in hosts}
    return trust, distrust


def test_ranks_are_the_plain_ones(spark):
    rng = random.Random(12)
    hosts = [f"h{k}.net" for k in range(6)] + ["a.org", "b.org", "s.com"]
    rows, edges, allowed, blocked = [], defaultdict(int), defaultdict(int), defaultdict(int)
    for k in range(40):
        host, path = rng.choice(hosts), rng.choice(("/x", "/de/1", ""))
        to = {rng.choice(hosts) for _ in range(rng.randint(0, 3))}
        rows.append((k, f"http://{host}{path}", "".join(f'<a href="https://{t}/p">x</a>' for t in to), "own"))
        for t in to - {host}:
            edges[host, t] += 1
        if host.endswith(".org"):
            allowed[host] += bool(path)
        elif host == "s.com":
            blocked[host] += path == "/de/1"
    rows += [(40, "http://a.org/x", None, "own"), (40, "http://a.org/x", None, "own"), (41, "http://s.com/de/2", "<a " * 50_000, "own")]
    allowed["a.org"] += 2
    blocked["s.com"] += 1
    trust, distrust = plain_ranks(edges, allowed, blocked, hosts)
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.isclose(r["trust"], trust[r["host"]], rtol=2e-3) and np.isclose(r["distrust"], distrust[r["host"]], rtol=2e-3)
        if r["decided_by"] == "host":
            t, d = trust[r["host"]], distrust[r["host"]]
            assert r["verdict"] == ("block" if d > t else "allow") or abs(t - d) < 1e-3 * (t + d)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_more_allowed_than_blocked_pages_of_a_host_allow_it(spark):
    rows = [(k, f"http://s.com/fr/{k}", None) for k in range(4)] + [(4 + k, f"http://s.com/de/{k}", None) for k in range(2)] + [(9, "http://s.com/", None)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "allow" and got[4] == "block"


def test_one_row_of_each_component_stays(spark):
    a, b = "one two three four five six seven eight nine ten", "quite another text of several words to stand alone here"
    rows = [(1, a, "x"), (1, a, "x"), (2, a, "y"), (3, b, "z"), (None, b, "w"), (None, "third text that only rows without an id have in here", "p"), (None, "third text that only rows without an id have in here", "q"), (4, None, "e"), (4, "", "f"), (1, "a text of its own though its id is one of the others", "g")]
    got = jaccard_join.first_of_each(spark.createDataFrame(rows, "doc_id long, text string, class string").repartition(3)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in got) == sorted([(True, 1, a), (True, 3, b), (False, 0, rows[5][1]), (True, 4, ""), (True, 4, ""), (True, 1, rows[9][1])])
    assert got[0].asDict().keys() == {"doc_id", "text", "class"}


def test_url_rules_and_links(spark):
    page = lambda *to: "".join(f'<a href="{u}">x</a>' for u in to)
    rows = [(0, "http://a.org/x", page("https://good.net/", "/own")), (1, "http://GOOD.net/p", page("//friend.info/")), (2, "http://friend.info", None), (3, "https://s.com/de/1", None), (4, "http://bad.net/", page("https://s.com/q?x")), (5, None, "x"), (6, "no scheme", None), (7, "http://b.example.org/es/1?u#f", None), (8, "http://aorg/x", None), (9, "http://a.org", None)]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == ("a.org", "/x", "org/", "allow")
    assert got[1] == ("good.net", "/p", None, "allow")
    assert got[2][3] == "allow"
    assert got[3] == ("s.com", "/de/1", "com/de/", "block")
    assert got[4] == ("bad.net", "/", None, "block")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("b.example.org", "/es/1", "example.org/es/", "block")
    assert got[8][2] is None and got[9][1:3] == ("", None)


def labelled(spark, bad: str, n: int = 240):
    rng = random.Random(9)
    syllables = ["an", "the", "re", "in", "on", "ti", "er", "st", "ou", "ed"]
    rows = []
    for i in range(n):
        w = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(60)]
        y = i % 4 == 0
        if y:
            w = w[:10] + [w[10]] * 50 if bad == "junk" else [x if rng.random() > 0.15 else rng.choice(("grumble", "zapfog")) for x in w]
        rows.append((i, " ".join(w), int(not y) if bad == "junk" else int(y)))
    rows += [(n, None, 0), (n + 1, "", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, y int").withColumn("score", F.lit("own"))


@pytest.mark.parametrize(("module", "bad"), [(quality, "junk"), (toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, module, bad):
    df = labelled(spark, bad)
    label = "quality" if bad == "junk" else "toxic"
    labels = df.filter("text <> ''").select("doc_id", F.col("y").alias(label))
    model = module.fit(df.drop("y"), labels, F.col("doc_id") % 3 != 1)
    got = quality.score(df, model).collect()
    assert len(got) == 242 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["doc_id"] % 3 == 1 and r["doc_id"] < 240]
    assert sum(r["predicted"] == r["y"] for r in held) / len(held) >= 0.95
    assert quality.kept(df, model, 1).count() == sum(r["predicted"] for r in got)
    assert quality.score(df.limit(0), model).count() == 0


def test_classifiers_without_labels(spark):
    df = labelled(spark, "junk", 8)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        assert {round(r["score"], 6) for r in quality.score(df, module.fit(df, none, F.lit(True))).collect()} == {0.5}


def unigram_model(pieces) -> bytes:
    """A hand-made unigram model file with byte fallback; pieces: (text, score)."""
    import struct as st

    def field(n: int, x) -> bytes:
        if isinstance(x, int):
            return varint(n << 3) + varint(x)
        if isinstance(x, float):
            return varint(n << 3 | 5) + st.pack("<f", x)
        return varint(n << 3 | 2) + varint(len(x)) + x

    def varint(x: int) -> bytes:
        out = b""
        while x > 127:
            out += bytes([x & 127 | 128])
            x >>= 7
        return out + bytes([x])

    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((p, s, 1) for p, s in pieces)]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in rows)
    trainer = field(3, 1) + field(35, 1)
    return out + field(2, trainer) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


def test_unigram_pieces_are_viterbis(spark, tmp_path):
    import sentencepiece

    rng = random.Random(3)
    letters = "▁abcdé"
    texts = {"▁", *letters, "▁a", "ab", "abc", "▁ab", "bcd", "cd", "dd", "▁▁"} | {"".join(rng.choice("abcd") for _ in range(rng.randint(2, 4))) for _ in range(20)}
    texts -= {"d"}  # a character that is no piece by itself
    texts = {t for t in texts if "dd" not in t}  # else paths tie
    path = str(tmp_path / "u.model")
    with open(path, "wb") as out:
        out.write(unigram_model([(t, -round(rng.uniform(1, 9), 3)) for t in sorted(texts)]))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(k, "".join(rng.choice("aabbccdd é日") for _ in range(rng.randint(0, 40)))) for k in range(200)] + [(200, None), (201, ""), (202, "  a  b")]
    got = word_trie.encode_pieces(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    assert word_trie.PieceModel.of(path).unigram
    for r, (_, text) in zip(sorted(got, key=lambda r: r["doc_id"]), rows, strict=True):
        assert r["ids"] == model.encode(text or ""), text


def test_round_trips(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = word_trie.round_trips(docs.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x")), PIECES).collect()
    want = sorted((None if i == 3 else i, len(model.encode(t or "")), crc(model.encode(t or "")), True) for i, t in enumerate(odd_texts()) if i != 3)
    assert sorted(tuple(r) for r in rows if r["doc_id"] is not None) == want
    assert len(rows) == docs.count()
    assert word_trie.round_trips(empty(spark), PIECES).count() == 0


def test_edited_counts_are_those_of_edited_texts(spark, docs):
    edits = F.array(*(edit_counts.edit(F.lit(a), F.lit(b), F.lit(t)) for a, b, t in ((3, 5, "é x"), (0, 1, ""), (10**6, 10**6, " end."), (2, 2, "\n"))))
    rows = docs.withColumn("edits", edits).withColumn("tokens_after", F.lit(0))
    made = edit_counts.apply_edits(edit_counts.token_trees(rows, BYTES), BYTES)
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_tokens"], len(r["text"].encode()), r["encoded_bytes"]) for r in made.collect())
    got = edit_counts.edited_counts(rows, BYTES).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["tokens_after"], r["bytes_after"], r["encoded_bytes"]) for r in got) == want
    before = {r["doc_id"]: r["tokens_before"] for r in got}
    assert all(before[None if i == 3 else i] == len(x) for i, x in enumerate(reference(BYTES, odd_texts())))
    assert edit_counts.edited_counts(empty(spark).withColumn("edits", edits), BYTES).count() == 0


def test_few_pieces_remembered_give_the_same_ids(monkeypatch):
    from navella.llm import tokens

    texts = odd_texts()
    want = reference(BYTES, texts)
    encoder = TextEncoder(BYTES)
    encoder.memory = tokens.Remembered(40, 200)
    monkeypatch.setattr(tokens, "SLICE", 64)
    for _ in range(2):
        assert [list(x) for x in encoder.encode_each(pa.array(texts))] == want


def test_id_files_of_small_size(spark, monkeypatch):
    monkeypatch.setattr(id_files, "FILE_IDS", 50)
    monkeypatch.setattr(id_files, "BLOCK_IDS", 16)
    texts = [(k % 4, f"text {j} of {k} " * (j * 50_000 + k)) for k in range(5) for j in range(3)] + [(1, "same"), (1, "same"), (None, "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    manifest = id_files.write_id_files(df, WORDS, 1)
    got = sorted(id_files.read_id_files(manifest).collect(), key=lambda r: r["start"])
    assert manifest.select("path").distinct().count() > 5
    ids = {t: x + [1] for t, x in zip([t for _, t in texts], reference(WORDS, [t for _, t in texts]), strict=True)}
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i is not None, i or 0, len(ids[t]), crc(ids[t])) for i, t in texts)
    assert [r["doc_id"] if r["doc_id"] is not None else -1 for r in got] == sorted(i if i is not None else -1 for i, _ in texts)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.run(spark, sf_dir)
    ids = {r["doc_id"] for r in kept.select("doc_id").distinct().collect()}
    assert 0 < len(ids) < docs.count()
    stage = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, stage, sf_dir)
        assert after.columns == docs.columns and after.count() <= stage.count()
        stage = after
    assert ids == {r["doc_id"] for r in stage.collect()}


def plain_runs(text):
    """(run, its short run) that end at each byte of a text: from the blank before the word, 2 to 12 bytes."""
    low = re.sub(rb"[^a-z0-9\x80-\xff]", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    b = b" " * 12 + low
    for e in range(12, len(b)):
        first = min(max(b.rindex(b" ", 0, e), e - 11), e - 1)
        yield b[first : e + 1], b[e - 2 : e + 1]


def hashed(run: bytes) -> int:
    b = np.frombuffer(b" " * 12 + run, np.uint8)
    return int(toxicity.span_hashes(b, np.array([12]), np.array([len(b)]))[0].view(np.int64))


def test_run_counts_take_every_labelled_row(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BATCH_RUNS", 50)
    monkeypatch.setattr(toxicity, "SLICE_DOCS", 7)
    texts = ["A stone; a Stone", "one stone " * 9, None, "", "x" * 4_000 + " late grumble", "日本 stone"] + [f"word {k} of a text" for k in range(60)]
    rows = [(t, k % 4) for k, t in enumerate(texts)]
    want = defaultdict(int)
    for t, code in rows:
        for run, _ in plain_runs(t):
            want[hashed(run), code] += 1
    got = toxicity.run_counts(spark.createDataFrame(rows, "text string, code int").repartition(3)).collect()
    assert {(r["run"], k): r[f"n{k}"] for r in got for k in range(4) if r[f"n{k}"]} == want


def plain_kneser_ney(counts):
    """counts: by label, run -> occurrences, and a last one of all; short: run -> its short run. The log-probability of each run
    by label, by the definition."""
    number = lambda c, k: sum(v == k for v in c.values())
    discount = lambda c: number(c, 1) / (number(c, 1) + 2 * number(c, 2)) if number(c, 1) else 0
    *labels, short = counts
    both = {r: labels[0].get(r, 0) + labels[1].get(r, 0) for r in set(labels[0]) | set(labels[1])}
    ends = defaultdict(int)
    for run in both:
        ends[short[run]] += 1

    def of(c, run, lower):
        kin = [v for r, v in c.items() if r[:-1] == run[:-1]]
        d = discount(c)
        if not kin:
            return lower
        left = sum(max(v - d, 0) for v in kin)
        return max(c.get(run, 0) - d, 0) / sum(kin) + max(1 - left / sum(kin), 1e-6) * lower

    return lambda run, y: np.log(of(labels[y], run, of(both, run, of(ends, short[run], 1 / 256))))


def test_kneser_ney_is_the_plain_one(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("stone", "grumble", "of", "the", "strong", "grumbling", "storm")) for _ in range(rng.randint(3, 9))) for _ in range(24)]
    rows = [(t, 2 * (k % 3 == 0) + (k % 5 == 0)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "text string, code int")
    for m, model in enumerate(toxicity.models(toxicity.run_counts(df))):
        counts = [defaultdict(int), defaultdict(int), {}]
        for t, code in rows:
            if m or code % 2 == 0:
                for run, short in plain_runs(t):
                    counts[code // 2][run] += 1
                    counts[2][run] = short
        log_p = plain_kneser_ney(counts)
        for t in texts[:6]:
            raw = np.frombuffer(t.encode(), np.uint8)
            text, place, _ = toxicity.canonical(raw, np.array([0, len(raw)]))
            got = model.differences(text, place)
            for d, (run, _) in zip(got, plain_runs(t), strict=True):
                if run in counts[2]:
                    assert d == pytest.approx(log_p(run, 1) - log_p(run, 0), abs=2e-3)
            words, at = [], 0
            for w in re.findall(r"\S+\s*", t):
                words.append(float(got[at : at + len(w)].sum()))
                at += len(w)
            k = max(2, -(-len(words) * 4 // 10))
            most = sum(sorted(words)[-k:]) / k
            assert np.allclose(model.measures(raw, np.array([0, len(raw)]), (0.4,)), [[most]], atol=1e-4)


def test_the_driver_packs_no_table_and_tasks_hold_half_precision(spark):
    rows = [(f"a {'grumbling' if k % 3 == 0 else 'friendly'} stone of the storm {k % 5}", 2 * (k % 3 == 0) + (k % 5 == 0)) for k in range(40)]
    *_, model = toxicity.models(toxicity.run_counts(spark.createDataFrame(rows, "text string, code int")))
    assert model.left.rows is None and model.before.rows is None
    sent = pickle.loads(pickle.dumps(model))
    raw = np.frombuffer(rows[0][0].encode(), np.uint8)
    got, want = (m.measures(raw, np.array([0, len(raw)]), (0.4,)) for m in (sent, model))
    assert np.allclose(got, want, atol=0.05) and want[0, 0] > 1
    assert len(sent.left) == 1 << toxicity.CELLS and sent.left.rows.nbytes == 6 * len(sent.left) and sent.left.parts is None
    assert sent.before.rows.nbytes == 12 * len(sent.before) == 12 << toxicity.BEFORE


def test_measures_of_several_documents_and_none():
    model = toxicity.constant(0.25)
    raw = np.frombuffer(b"a bc d", np.uint8)
    assert model.measures(raw, np.array([0, 4, 4, 6]), (0.1, 0.5)).tolist() == [[0.0] * 3] * 2
    assert np.allclose(model.scores(raw, np.array([0, 6])), 0.25) and model.scores(raw[:0], np.array([0, 0])).tolist() == [0.25]


def test_cut_has_the_fewest_errors():
    m, y = np.array([3.0, 1.0, 2.0, 2.0, 5.0, 4.0]), np.array([1, 0, 0, 1, 1, 0])
    cut, loss = toxicity.best_cut(m, y, np.ones(6))
    assert (cut, loss) == (4.5, 2.0) or loss == min(((m >= c) != y).sum() for c in (0, 1.5, 2.5, 3.5, 4.5, 9))
    assert toxicity.best_cut(m, y, np.where(y == 1, 5.0, 1.0)) == (1.5, 2.0)


def test_discounts_lie_between_0_and_1():
    assert [toxicity.discount(*x) for x in ((0, 0), (5, 0), (4, 3))] == [0, 1, 0.4]


def test_quality_step_is_the_gradient(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 1)
    monkeypatch.setattr(quality, "STEPS", 1)
    monkeypatch.setattr(quality, "BUCKETS", 64)
    rows = [(np.array([1, 5, 9]), np.array([2, 1, 1]), 1), (np.array([2, 5]), np.array([1, 3]), 0)]
    got = quality.train(rows, 0.5)
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / 16, 1 / 16, (64 + quality.MARKS, 16))
    layer, bias = rng.normal(0, 0.1, (16, 2)), np.zeros(2)
    loss = lambda v, w, b, f, s, y: np.log(np.exp((s @ v[f]) @ w + b).sum()) - ((s @ v[f]) @ w + b)[y]
    for k, i in enumerate(rng.permutation(2)):
        f, c, y = rows[i]
        s, rate, eps = c / c.sum(), quality.RATE * (1 - k / 2), 1e-6
        grads = []
        for x in (vectors, layer, bias):
            g = np.zeros_like(x)
            for at in np.ndindex(*x.shape):
                if x is not vectors or at[0] in f:
                    x[at] += eps
                    up = loss(vectors, layer, bias, f, s, y)
                    x[at] -= 2 * eps
                    g[at] = (up - loss(vectors, layer, bias, f, s, y)) / (2 * eps)
                    x[at] += eps
            grads.append(g)
        for x, g in zip((vectors, layer, bias), grads, strict=True):
            x -= rate * g
    assert np.allclose(got.weight, vectors @ (layer[:, 1] - layer[:, 0]), atol=1e-4)


def test_quality_features_are_the_plain_ones():
    text = "Aa aa AA 12 .. aa aa é" + " x" * 3
    raw = np.frombuffer(text.encode(), np.uint8)
    f, owner = quality.features(raw, np.array([0, len(raw)]))
    words = text.split(" ")
    shapes = [sum(a == b for a, b in zip(words, words[1:], strict=False)), 1, 1, 1, 0, sum(len(w.encode()) < 3 for w in words)]
    assert [(f == quality.BUCKETS + k).sum() for k in range(6)] == shapes
    assert (f < quality.BUCKETS).sum() == len(words) + sum(len(raw) - n + 1 for n in quality.RUNS)
    assert (owner == 0).all()


def test_conflicting_and_null_labels(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (None, 1), (3, 7), (4, 0), (4, 0)], "doc_id long, toxic int")
    got = {(r["doc_id"], r["y"]) for r in quality.labels_of(labels, "toxic", F.lit(True)).collect()}
    assert got == {(1, 1), (2, 0), (4, 0)}
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "c")], "doc_id long, text string")
    sample, share = quality.labelled_sample(docs, labels, "toxic", F.lit(True), 10)
    assert sorted((r["doc_id"], r["text"], r["y"]) for r in sample.collect()) == [(1, "a", 1), (1, "b", 1), (2, "", 0)]
    assert share == 1 / 3


def test_toxicity_learns_from_long_texts(spark):
    rng = random.Random(4)
    syllables = ["an", "the", "re", "in", "on", "ti", "er", "st", "ou", "ed"]
    rows = []
    for i in range(120):
        w = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(60 if i % 4 else 9000)]
        rows.append((i, " ".join(w if i % 4 else [x if rng.random() > 0.15 else rng.choice(("grumble", "zapfog")) for x in w]), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert df.filter("toxic = 1").agg(F.min(F.length("text"))).first()[0] > 30_000
    got = quality.score(df, toxicity.fit(df.drop("toxic"), df.drop("text"), F.col("doc_id") % 3 != 1)).filter("doc_id % 3 = 1").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) / len(got) >= 0.95


def test_toxicity_in_several_scripts(spark):
    """Stems that are ordinary words by themselves, and toxic with an ending, among words of each script's syllables."""
    rng = random.Random(9)
    scripts = {"en": ["an", "the", "re", "ti", "er", "st", "ou"], "de": ["ü", "ach", "keit", "lich", "ein", "heit", "ö"], "ru": ["ста", "но", "при", "ве", "ть", "го", "му"], "ja": ["日", "本", "語", "文", "字", "書", "読"]}
    bad = {k: "".join(v[:3]) for k, v in scripts.items()}
    rows = []
    for i in range(1600):
        lang = list(scripts)[i % 4]
        words = ["".join(rng.choices(scripts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(40, 200))]
        toxic = i // 4 % 4 == 0
        for _ in range(max(3, len(words) // 20) if toxic else 2):
            words[rng.randrange(len(words))] = bad[lang] + (rng.choice(scripts[lang]) + rng.choice(["", "s"]) if toxic else "")
        rows.append((i, " ".join(words), int(toxic), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    got = quality.score(df, toxicity.fit(df.drop("toxic"), df.drop("text"), F.col("doc_id") % 5 != 1)).filter("doc_id % 5 = 1").collect()
    for lang in scripts:
        toxic, clean = ([r["predicted"] for r in got if r["lang"] == lang and r["toxic"] == y] for y in (1, 0))
        assert sum(toxic) / len(toxic) >= 0.9 and sum(clean) / len(clean) <= 0.02, lang


@pytest.mark.parametrize("block", [512, 3])
def test_every_link_is_found(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(8)
    base = [f"b{rng.randrange(500)}" for _ in range(200)]
    family = {}
    for k in range(40):
        t = list(base)
        for _ in range(k % 4):
            t[rng.randrange(200)] = f"n{k}"
        family[2000 + k] = " ".join(t)
    texts = near_corpus() | family
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    want = {i: sum(j != i and bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets) for i in sets}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["n_links"] for r in jaccard_join.component_ids(df).collect()} == want
    assert max(want.values()) >= 39


def test_distrust_reaches_far_hosts(spark):
    rows = [(k, f"http://h{k}.net/", f'<a href="http://h{k + 1}.net/">x</a>') for k in range(24)]
    rows += [(24, "http://h24.net/", '<a href="https://s.com/">x</a>'), (25, "https://s.com/de/1", None)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == dict.fromkeys(range(26), "block")


def test_repeated_rows_of_a_query_id_hide_no_other_id(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4)).astype(np.float32) * 0.01
    rows = [(0, [9.0, 0.0, 0.0, 0.0])] * 25 + [(k, [9.0, 0.0, 0.0, 0.0]) for k in (1, 2, 3)] + [(100 + i, v.tolist()) for i, v in enumerate(x)]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, 20).filter("rank <= 3").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3]


@pytest.mark.parametrize("block", [512, 7])
def test_every_link_is_listed_and_counted(spark, monkeypatch, block):
    """Components of up to and of more classes than a block; a chain whose ends aren't similar has fewer links than pairs."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    chain = {3000 + k: " ".join(f"c{j}" for j in range(4 * k, 4 * k + 120)) for k in range(30)}
    texts = near_corpus() | chain | {3100: chain[3004]}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in ((i, (t or "").lower().split()) for i, t in texts.items())}
    want = {(a, b) for a in sets for b in sets if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    rows, _, pairs = jaccard_join.similar_pairs(df)
    members = {}
    for r in rows.collect():
        if r["class"] is not None:
            members.setdefault(r["class"], []).append(r["doc_id"])
    listed = [(r["a"], r["b"]) for r in pairs.collect()]
    assert len(listed) == len(set(listed)) and all(a < b for a, b in listed)
    found = {(x, y) for a, b in [*listed, *((c, c) for c in members)] for p, q in ((a, b), (b, a)) for x in members[p] for y in members[q] if x != y}
    assert found == want
    assert {r["doc_id"]: r["n_links"] for r in jaccard_join.component_ids(df).collect()} == {i: sum(a == i for a, _ in want) for i in texts}
