"""Operators 11 to 13 against plain versions, on odd cases: nulls, empty and long texts, ties, repeated rows, empty tables,
clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from oracle import difference
from pyspark.sql import functions as F

from navella.llm import merkle, prefix_trie, secret_scan
from navella.llm.queries import ORACLES, QUERIES

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, tree string, place long, base string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# secrets


def plain_spans(text):
    """The patterns as they are stated, dropping short matches afterwards."""
    out = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return [(k, a, b) for a, k, b in sorted(out)]


def odd_secrets():
    rng = random.Random(5)
    parts = ["token=", "PassWord : '", "api_key=\"", "APIKEY=", "secret", ": ", "AKIA", "AKIAAKIA", "ABCDEF0123456789", "deadbeefdeadbeef", "0123456789abcde", "日本", "ſecret=", "toKen = ", "short", " ", "\n", "abcdefghijkl", "=", "é", "x.y-z/w+v", "password password: "]
    fixed = [None, "", "token: password: abcdefghijklmnop", "ſecret=abcdefghijkl", "toKen=abcdefghijkl", "AKIA" + "A" * 13, "AKIA" + "A" * 14, "f" * 15, "f" * 16 + "G", "a" * 200_000, "日token=abcdefghijkl", "same token=abcdefghijklm", "same token=abcdefghijklm"]
    return fixed + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)]


def test_patterns_are_those_stated():
    for text in odd_secrets():
        assert secret_scan.base_spans(text or "")[0] == plain_spans(text or "")


def test_scan_of_odd_rows(spark):
    texts = odd_secrets()
    df = spark.createDataFrame([(None if i == 3 else i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, base string, runs long").repartition(3)
    got = secret_scan.scan(df).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[3 if r["doc_id"] is None else r["doc_id"]] or ""
        named = lambda spans: [(secret_scan.KINDS.index(s["kind"]), s["start"], s["end"]) for s in spans]
        assert named(r["base"]) == plain_spans(text)
        every = named(r["spans"])
        assert every == sorted(every, key=lambda s: (s[1], s[0])) and [s for s in every if s[0] < 3] == plain_spans(text)
        for _, a, b in [s for s in every if s[0] == 3]:
            assert re.fullmatch("[A-Za-z0-9+/_=-]{12,}", text[a:b])
    assert secret_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_markov_models_tell_random_strings_of_other_alphabets(spark):
    rng = random.Random(2)
    words = ["internationalisation", "configurationmanager", "unbelievableproperties", "straightforwardness", "responsibilities", "characterisation"]
    symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(symbols) for _ in range(24)) for _ in range(40)]
    rows = [(i, f"the {rng.choice(words)}{rng.choice(['', 'es', 'ly'])} token={rng.getrandbits(128):032x} of {rng.choice(words)}") for i in range(400)]
    rows += [(1000 + i, f"see {rng.choice(words)} and {k} there") for i, k in enumerate(keys)]
    found = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == "markov"] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(len(found[i]) for i in range(400)) == 0
    hits = sum(any(text[s["start"] : s["end"]] in keys for s in found[i]) for i, text in rows[400:])
    assert hits >= 36 and sum(len(v) for v in found.values()) == hits


def test_shares_add_up_and_follow_counts():
    counts = np.zeros(secret_scan.CELLS, np.int64)
    cell, owner = secret_scan.cells(["abab", "ab"])
    assert owner.tolist() == [0, 0, 0, 0, 1, 1]
    np.add.at(counts, cell, 1)
    p = secret_scan.shares(counts)
    assert np.allclose(p.sum(-1), 1)
    a, b, start = secret_scan.SYMBOLS.index("a"), secret_scan.SYMBOLS.index("b"), secret_scan.N
    assert p[start, start, a] > 0.3 and p[start, a, b] > 3 * p[start, a, a]


# the manifest


@pytest.mark.parametrize("height", range(12))
def test_addresses_are_a_permutation(height):
    def order(levels):  # (depth, index) from the layout's definition
        if levels == 1:
            return [(0, 0)]
        upper = levels // 2
        below = order(levels - upper)
        return order(upper) + [(upper + d, (t << d) + i) for t in range(1 << upper) for d, i in below]

    want = {node: k for k, node in enumerate(order(height + 1))}
    for depth in range(height + 1):
        assert merkle.address(height, depth, np.arange(1 << depth)).tolist() == [want[depth, i] for i in range(1 << depth)]


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels_of(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        row = found[-1]
        found.append([sha("".join(row[i : i + 2])) for i in range(0, len(row), 2)])
    return found


def plain_proofs(rows, claims):
    """rows of (doc_id, source, lang, n_chars, text); yields what proofs does, by lists."""
    trees = defaultdict(list)
    for r, claim in zip(rows, claims, strict=True):
        trees[r[2]].append((r[0] is not None, r[0] or 0, sha("".join(map(field, r))), r[0], claim))
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    inner = {k: levels_of([x[2] for x in sorted(v)]) for k, v in trees.items()}
    outer = levels_of([inner[k][-1][0] for k in order])
    for k in order:
        for i, (_, _, leaf, doc_id, claim) in enumerate(sorted(trees[k])):
            x, proof = claim, ""
            for levels, at in ((inner[k], i), (outer, order.index(k))):
                for row in levels[:-1]:
                    pair = row[at // 2 * 2 : at // 2 * 2 + 2]
                    proof += "".join(s for j, s in enumerate(pair) if j != at % 2)
                    pair[at % 2] = x
                    x, at = sha("".join(pair)), at // 2
            yield doc_id, leaf, inner[k][-1][0], outer[-1][0], proof, x, x == outer[-1][0]


@pytest.mark.parametrize("height", [1, 3, 8])
def test_proofs_of_odd_rows(spark, height):
    rng = random.Random(height)
    rows = [(None, "s", "en", 1, "x"), (5, None, None, None, None), (6, "", "", 0, ""), (7, "s", "日本", 2, "é"), (9, "s", "en", 2**63 - 1, "long " * 50_000)]
    rows += [(rng.randint(0, 900), rng.choice("ab"), rng.choice(["en"] * 9 + ["de", None]), rng.randint(0, 50), str(rng.random())) for _ in range(333)]
    rows += [(44, "s", "en", 3, "same")] * 40
    leaves = [sha("".join(map(field, r))) for r in rows]
    tampered = [i % 3 == 0 for i in range(len(rows))]
    claims = [sha("tampered" + x) if t else x for x, t in zip(leaves, tampered, strict=True)]
    for i in range(len(rows)):  # repeated rows, one like the other
        if rows[i][4] == "same":
            claims[i] = leaves[i]
    df = spark.createDataFrame([(a, e, c, b, d, "x", 1, k) for (a, b, c, d, e), k in zip(rows, claims, strict=True)], DOCUMENTS).repartition(4)
    got = sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified")) for r in merkle.proofs(df, F.unhex("base"), height).collect()), key=str)
    assert got == sorted(plain_proofs(rows, claims), key=str)
    assert merkle.proofs(spark.createDataFrame([], DOCUMENTS), F.unhex("base")).count() == 0


# the trie


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}")[:32], (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def below(node):
        todo, found = [node], []
        while todo:
            found.append(x := todo.pop())
            todo += kids[x]
        return found

    for node, cs in members.items():
        under = below(node)
        saved = sum((len(members[x]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", x[-1][1])) for x in under if x)
        ended = ",".join(str(c) for c in sorted(cs) if built[c] == node)
        yield min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids[node]), sum(not kids[x] for x in under), saved, sha(ended)


CONVERSATIONS = "conv_id long, turn long, role string, text string, id string, block long, size long"


@pytest.mark.parametrize("span", [2, 4096])
def test_trie_of_odd_rows(spark, monkeypatch, span):
    monkeypatch.setattr(prefix_trie, "SPAN", span)
    rng = random.Random(span)
    rows = []
    for c in range(160):
        if c % 20 == 0 and c > 100:
            continue  # no base conversation
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, 9, 17, 40])):
            rows.append((c, None if t == 0 and c % 7 == 0 else t, rng.choice(["user", None, ""]), rng.choice(["a b", "a  b c", "", None, "x"])))
    for c in range(200, 320):  # the same at great length
        rows += [(c, t, "user", f"word {t}") for t in range(30)]
    rows += [(330, 1, "user", "tie b"), (330, 1, "user", "tie a"), (330, 1, "user", "tie a"), (None, 1, "user", "nobody's"), (331, 0, "user", "w " * 100_000)]
    df = spark.createDataFrame([(*r, "x", 3, 4) for r in rows], CONVERSATIONS).repartition(3)
    assert sorted(map(tuple, prefix_trie.trie(df).collect()), key=str) == sorted(plain_trie(rows), key=str)


def test_trie_without_turns(spark):
    assert prefix_trie.trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    only = [(3, 0, "user", "gone")]
    assert zlib.crc32(b"3") % 4 >= 1
    assert [tuple(r) for r in prefix_trie.trie(spark.createDataFrame([(*r, "x", 3, 4) for r in only], CONVERSATIONS)).collect()] == list(plain_trie(only))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, sf_dir, name):
    assert difference(spark, QUERIES[name], ORACLES[name], sf_dir) == ""


def test_secrets_query_has_the_plain_spans(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op11_secrets"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain_spans(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in spans) for k in range(3)]
        joined = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == sha(joined)
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("markov")) == joined
