"""Personal data, the Merkle manifest and hard negatives against plain versions, and their edges."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftlens.llm import hard_negatives, hashfiles, manifest, pii
from driftlens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

# ---- personal data ---------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(int(c) for c in digits[::-1]):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    only = lambda s: re.sub(r"[^0-9]", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(only(m[0])) <= 19 and luhn(only(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(only(m[0])) <= 15],
    }


def base_of(text):
    found = pii.spans(text)
    return {kind: found[kind] for kind in pii.BASE}


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab@.-+ ()0129%é\n", max_size=60))
def test_base_kinds_match_their_patterns(text):
    assert base_of(text) == plain_spans(text)


def test_base_kinds_in_awkward_places():
    texts = [
        "a@b.c@d.e.f x@y @z.w a@b..c a.@-.- İ@x.y é@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.1.1 0255.000.1.2", "4111 1111 1111 1111 4111-1111-1111-1111-4 4111  1111",
        "+1 (555) 010-9999) +1.... +12 +1 555 0109999 555 0109999 +49-30-1234567.", "5500005555555559 5500005555555558 +5500005555555559", "4111111111111111" * 3,
        "1" * 5000 + ".1.1.1", "x" * 200_000 + "@" + "y." * 5 + "z", "+" + "1 " * 100_000, ".".join("1" for _ in range(9999)), "",
    ]
    for text in texts:
        got, want = base_of(text), {k: plain_spans(text)[k] if not (k == "ip" and len(text) == 5006) else [] for k in pii.BASE} if len(text) != 5006 else None
        if want is None:
            assert got["ip"] == [] and got["email"] == []
        else:
            assert got == want, text[:80]


def test_announced_kinds():
    text = "IBAN: GB82 WEST 1234 5698 7654 32, iban GB82WEST12345698765433; acct no. 1234-5678-90 SSN 123-45-6789 ssn 000-12-3456 https://bob:secret@host/x http://a.b/c"
    found = pii.spans(text)
    assert [text[a:b] for a, b in found["iban"]] == ["GB82 WEST 1234 5698 7654 32"]
    assert [text[a:b] for a, b in found["account"]] == ["1234-5678-90"]
    assert [text[a:b] for a, b in found["ssn"]] == ["123-45-6789"]
    assert [text[a:b] for a, b in found["login"]] == ["bob:secret"]
    assert pii.masked("mail a@b.c now") == "mail [email] now"


def test_personal_data_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op11_pii"](spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        want = plain_spans(texts[r["doc_id"]])
        line = ",".join(f"{kind}:{a}:{b}" for kind in pii.BASE for a, b in want[kind])
        assert [r[f"n_{kind}"] for kind in pii.BASE] == [len(want[kind]) for kind in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and r["spans"].startswith(line)
    # Documents without a base find hold no announced one either.
    assert all(r["spans"] == "" for r in rows if not any(r[f"n_{kind}"] for kind in pii.BASE))


def test_personal_data_edges(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a@b.c " * 50_000, "z"), (3, "a@b.c", "z"), (3, "a@b.c", "z"), (None, "1.2.3.4", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("n_email", F.lit("clash"))
    got = sorted(((r["doc_id"] or 0, r["n_email"], r["n_ip"]) for r in pii.digests(pii.find(docs)).collect()))
    assert got == [(0, 0, 1), (1, 0, 0), (2, 0, 0), (3, 1, 0), (3, 1, 0), (3, 50_000, 0)]
    assert pii.find(docs.where("false")).count() == 0


# ---- manifest --------------------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    spell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*[spell(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def plain_manifest(rows, tamper):
    """A list of the query's columns for each row of a list, by climbing the tree node by node."""
    paths = defaultdict(list)

    def climb(nodes):
        while len(nodes) > 1:
            above = []
            for i in range(0, len(nodes), 3):
                run = nodes[i : i + 3]
                for k, (_, members) in enumerate(run):
                    for m in members:
                        paths[m].append((k, [x for j, (x, _) in enumerate(run) if j != k]))
                above.append((h(*[x for x, _ in run]), [m for _, members in run for m in members]))
            nodes = above
        return nodes[0]

    groups = defaultdict(list)
    for i, row in enumerate(rows):
        groups[row["source"]].append((row["doc_id"] is not None, row["doc_id"] or 0, plain_leaf(row, row["text"]), i))
    subroots, of = [], {}
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        top, members = climb([(leaf, [i]) for _, _, leaf, i in sorted(groups[source])])
        of.update(dict.fromkeys(members, top))
        subroots.append((top, members))
    root = climb(subroots)[0] if rows else None
    out = []
    for i, row in enumerate(rows):
        node = plain_leaf(row, tamper(row))
        for k, others in paths[i]:
            node = h(*others[:k], node, *others[k:])
        proof = h(*[x for _, others in paths[i] for x in others])
        out.append((row["doc_id"], plain_leaf(row, row["text"]), of[i], root, proof, node, node == root))
    return out


def key(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, None: 1, "é": 4, "Z": 28}, {"s": 300, "t": 243, "u": 244, **{f"g{i}": 1 + i % 3 for i in range(260)}}])
def test_manifest_matches_a_tree_climbed_node_by_node(spark, sizes):
    rng = random.Random(len(sizes))
    rows, ids = [], list(range(-500, 3_000_000, 1237))
    rng.shuffle(ids)
    for source, n in sizes.items():
        rows += [(ids.pop(), rng.choice([None, "", "x\ny", "é\n\n"]), rng.choice([None, "en"]), source, rng.choice([None, 5])) for _ in range(n)]
    rows += [(rows[0][0], "again", "en", rows[0][3], 1)] * 2 + [(None, "nobody's", None, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("leaf", F.lit("clash"))
    tamper = lambda r: r["text"].replace("\n", "") if r["text"] and (r["doc_id"] or 0) % 2 else r["text"]
    changed = F.when(F.coalesce("doc_id", F.lit(0)) % 2 != 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = sorted(map(tuple, manifest.prove(docs.repartition(3), changed).collect()), key=key)
    assert got == sorted(plain_manifest(docs.collect(), tamper), key=key)


def test_an_empty_table_has_no_leaves(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest.prove(docs).collect() == []


def test_containers_rank_and_merge():
    rng = np.random.default_rng(3)
    for size in (1, 10, manifest.LISTED, manifest.LISTED + 5, 60_000):
        lows = np.sort(rng.choice(1 << 16, size, replace=False))
        copies = np.where(rng.random(size) < 0.01, 3, 1)
        own = manifest.Container(lows, copies)
        at = rng.integers(0, 1 << 16, 500)
        want = np.array([copies[: np.searchsorted(lows, x)].sum() for x in at])
        assert (own.rank(at) == want).all()
        back = manifest.Container.pairs(own.to_bytes())
        assert (back[0] == lows).all() and (back[1] == copies).all()
        other = manifest.Container(lows[::2], np.ones(len(lows[::2]), np.int64))
        both = manifest.Container.pairs(manifest.merged([own.to_bytes(), other.to_bytes()]).to_bytes())
        want = copies.copy()
        want[::2] += 1
        assert (both[0] == lows).all() and (both[1] == want).all()


# ---- hard negatives --------------------------------------------------------------------------------------------------


def plain_negatives(rows):
    keep = []
    for i, e, label in rows:
        if label is not None and e is not None and len(e) and all(v is not None and np.isfinite(v) for v in e):
            keep.append((i, (label + 1) % 10 if i % 7 == 0 else label, np.floor(np.array(e, np.float64) * 256).astype(np.int64)))
    out = []
    for a, label, q in keep:
        if a % 100:
            continue
        scored = [(-int(x @ q), i, own) for i, own, x in keep if len(x) == len(q)]
        negatives = sorted((s, i) for s, i, own in scored if own != label)
        for p, positive in sorted((s, i) for s, i, own in scored if own == label and i != a)[:5]:
            fit = [(n, i) for n, i in negatives if 30 * -p <= 100 * -n <= 90 * -p][:10]
            out += [(a, positive, rank, i, -p, -n) for rank, (n, i) in enumerate(fit, 1)]
    return sorted(out)


def relabelled(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.prepared(df.withColumn("label", label), hard_negatives.whole_numbers())


@pytest.mark.parametrize("part,spread", [(40, 0.05), (4096, 3.0)])
def test_negatives_match_all_products(spark, monkeypatch, part, spread):
    monkeypatch.setattr(hard_negatives, "PART", part)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 100)
    rng = np.random.default_rng(part)
    base = rng.normal(size=(12, 6))
    rows = []
    for i in range(900):
        x = (base[i % 12] + spread * rng.normal(size=6)) * 2.0 ** rng.integers(-3, 4)
        rows.append((i, [float(v) for v in x.astype(np.float32)], int(rng.integers(0, 4))))
    rows += [(900 + i, rows[3][1], int(i % 2)) for i in range(60)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 6, 1), (1100, [0.0] * 6, 2), (1101, [float("nan")] * 6, 1), (1200, [1.0] * 6, None), (1300, [1.0, 2.0], 1), (1301, [1.0, 2.0], 1), (1302, [0.5, 1.0], 2), (1303, [None] * 6, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("clash"))
    got = sorted(tuple(r) for r in hard_negatives.mine(relabelled(df), F.col("id") % 100 == 0).collect())
    assert got == plain_negatives(rows)


def test_candidates_hold_all_that_reach_the_bound():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 5))
    x /= np.linalg.norm(x, axis=1)[:, None] / rng.uniform(1, 1.1, 3000)[:, None]
    own = hard_negatives.Part(np.arange(3000), np.zeros(3000, int), x)
    pruned = 0
    for q in rng.normal(size=(40, 5)):
        bound = np.sort(x @ q)[-20]
        found = own.candidates(q, bound)
        assert set(np.flatnonzero(x @ q >= bound)) <= set(found)
        pruned += len(found) < 1500
    assert pruned > 20


def test_no_rows_no_negatives(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(relabelled(df), F.col("id") % 100 == 0).collect() == []


# ---- sorted files ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("mapped", [True, False])
def test_sorted_files_find_all_rows(spark, mapped):
    rng = np.random.default_rng(1)
    hashes = np.concatenate([rng.integers(-(1 << 63), (1 << 63) - 1, 20_000), np.full(3000, 77), np.arange(5000)])
    rows = spark.createDataFrame([(int(x), int(i)) for i, x in enumerate(hashes)], "f long, v int").repartition(5)
    files = hashfiles.write(rows, "test")
    files.mapped = mapped
    wanted = np.unique(np.concatenate([hashes[::7], [77, 78, 5001, -1, (1 << 63) - 1], rng.integers(-(1 << 63), (1 << 63) - 1, 3000)]))
    counts, (values,) = files.reader().find(wanted)
    want = defaultdict(list)
    for i, x in enumerate(hashes.tolist()):
        want[x].append(i)
    ends = np.cumsum(counts)
    assert [values[e - c : e].tolist() for c, e in zip(counts, ends)] == [want.get(x, []) for x in wanted.tolist()]
    empty = hashfiles.write(rows.where("false"), "test")
    assert empty.reader().find(wanted)[0].sum() == 0
