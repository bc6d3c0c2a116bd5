"""Fingerprints, conversation repair and hard negatives: against SQL twins and brute force, and on odd input."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scenova.llm import conversations, fingerprints, negatives, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_hard_negatives"])
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = con.sql(queries.ORACLE_SQL[name]).df()
    ours = queries.QUERIES[name](spark, SF).toPandas()[list(theirs.columns)]
    assert len(ours) and sorted(map(tuple, ours.astype(str).to_numpy())) == sorted(map(tuple, theirs.astype(str).to_numpy()))


# Fingerprints


def plain_fingerprint(raw: bytes) -> str:
    """Byte by byte."""
    turned = lambda x, k: ((x << k) | (x >> (32 - k))) & 0xFFFFFFFF
    table, padded, levels = fingerprints.BYTES.tolist(), bytes(8) + raw, []
    for i in range(len(raw)):
        h = 0
        for back in range(8):
            h ^= turned(table[padded[i + 8 - back]], back)
        h >>= 4
        levels.append((h ^ (h + 1)).bit_length() - 1)
    scale = fingerprints.LEAST
    while sum(x >= scale for x in levels) >= fingerprints.MOST:
        scale += 1

    def symbols(k):
        out, start = "", 0
        for end in [i + 1 for i, x in enumerate(levels) if x >= k] + [len(raw)]:
            if end > start:
                v = sum((b + 1) * pow(int(fingerprints.ODD), j, 1 << 64) for j, b in enumerate(raw[start:end])) % (1 << 64)
                v ^= v >> 31
                out += fingerprints.SYMBOLS[(v * 0xBF58476D1CE4E5B9 % (1 << 64)) >> 52].decode()
            start = end
        return out

    return f"{scale}:{symbols(scale)}:{symbols(scale + 1)}"


def test_fingerprints_byte_by_byte():
    rng = random.Random(1)
    raws = [b"", b"a", b"abc", b"x" * 500, ("word " * 300).encode(), "ünïcode 日本語 👍".encode() * 40] + [bytes(rng.choices(range(32, 127), k=rng.choice([5, 60, 900, 5000]))) for _ in range(30)] + [b""]
    want = [plain_fingerprint(r) for r in raws]
    assert fingerprints.fingerprints_of(raws) == want == fingerprints.sliced(raws)
    assert [fingerprints.fingerprints_of([r])[0] for r in raws] == want
    assert all(len(s) <= 2 * fingerprints.MOST for f in want for s in f.split(":")[1:])


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (["".join(rng.choices("AB", k=2)) for _ in range(rng.randrange(0, 65))] for _ in "ab")
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        assert fingerprints.edit_distance("".join(a), "".join(b)) == row[-1]
    assert fingerprints.likeness("2::", "2::") == 1.0 and fingerprints.likeness("2::", "2:AB:AB") == 0.0 and fingerprints.likeness("2:AB:CD", "5:AB:CD") == 0.0


def brute_edits(rows):
    key = lambda r: (r[0] is None, -(r[0] or 0), r[2])
    rows, out = sorted(rows, key=key), []
    for i, (doc, text, _) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        own, other, later = fingerprints.sliced([text.encode(), changed.encode(), following.encode()])
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other, fingerprints.likeness(own, other), fingerprints.likeness(own, later)))
    return out


def plain(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("bucket, hot", [(256, 10_000), (1, 10_000), (3, 4)])
def test_fingerprints_of_odd_rows(spark, monkeypatch, bucket, hot):
    monkeypatch.setattr(fingerprints, "BUCKET", bucket)
    monkeypatch.setattr(fingerprints, "HOT", hot)
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("abcdefg", k=rng.randrange(2, 8))) for _ in range(n))
    rows = [(i, prose(rng.randrange(1, 400))) for i in range(-5, 60)]
    rows += [(7, prose(50)), (None, prose(30)), (None, None), (None, ""), (61, None), (62, ""), (63, " "), (64, "日本語👍" * 30), (65, prose(40_000)), (-(2**63), prose(9)), (2**63 - 1, prose(9))]
    rows += [(20, "the same row many times over and over")] * 30 + [(None, "no id and many times")] * 9
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, bucket string, key string").repartition(5)
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    assert plain(fingerprints.fingerprint_edits(docs).collect()) == plain(brute_edits([tuple(r) for r in hashed.collect()]))
    one = docs.where("doc_id = 62")
    assert [r["near_next"] for r in fingerprints.fingerprint_edits(one).collect()] == [1.0]
    assert fingerprints.fingerprint_edits(docs.where("false")).count() == 0


def test_fingerprints_tell_documents_apart(spark):
    rows = queries.QUERIES["op11_piecewise_fingerprints"](spark, SF).toPandas()
    assert rows["near_edited"].mean() > 0.55 and rows["near_next"].mean() < 0.05 and len(rows) == 200


# Conversations


def draw(conv, turn):
    return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20


def brute_repair(rows):
    """Cheapest sequence of edits by a search over all of them, for short conversations."""
    held = {}
    for conv, turn, role, text in rows:
        role, text, d = " " if role is None else role, " " if text is None else text, draw(conv, turn)
        kept = held.setdefault(conv, [])
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            kept += [(turn, "user" if d == 4 else role, text)] * (1 + (d == 3))
    out = []
    for conv, turns in held.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {("", (), ""): 0}  # roles so far, repaired, audit
        insert = lambda now: {k: min(c for kk, c in both if kk == k) for both in [[*now.items(), *(((r + i, d + ((w, ""),), a + "I"), c + 3) for (r, d, a), c in now.items() for i, w in (("u", "user"), ("a", "assistant")))]] for k, _ in both}
        fits = lambda r: re.fullmatch("s?(ua)*u?", r)
        prune = lambda now: {min(ks, key=lambda k: (now[k], k[2])): min(now[k] for k in ks) for ks in [[k for k in now if (k[0][-1:], k[0][:1] == "s" and len(k[0]) == 1, not k[0]) == s] for s in {(k[0][-1:], k[0][:1] == "s" and len(k[0]) == 1, not k[0]) for k in now}]}
        for (_, role, text), fault in zip(turns, faults):
            for _ in range(2):
                best = {k: c for k, c in insert(best).items() if fits(k[0])}
            then = {}
            for (r, d, a), c in best.items():
                then[(r, d, a + "D")] = c + 4
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    then[(r + (role[:1] or "?"), d + ((role, text),), a + "K")] = c + more
                    for i, w in (("u", "user"), ("a", "assistant")):
                        then[(r + i, d + ((w, text),), a + "R")] = c + 3 + more
            best = prune({k: c for k, c in then.items() if fits(k[0])})
        for _ in range(2):
            best = {k: c for k, c in insert(best).items() if fits(k[0])}
        cost, audit, done = min((c, a, d) for (r, d, a), c in best.items() if re.fullmatch("(s?(ua)+)?", r))
        numbers = {t for t, _, _ in turns if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return out


@pytest.fixture(scope="module")
def odd_turns():
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ugly"], ["Yes.", "No!", "why", " \t\n", "", None, "done? ", "a\x0b.", "é。", "Same."]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(120) for t in range(rng.randrange(1, 9))]
    rows += [(200, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in (0, 1, 2, 5, 9, -3)]
    rows += [(None, t, "user", "null conversation.") for t in (0, None, 3, None)] + [(201, None, "assistant", f"{x}.") for x in "abc"]
    rows += [(202, 1, "user", "again and again.")] * 40
    dropped = next(t for t in range(100) if draw(203, t) == 0)
    return rows + [(203, dropped, "user", "gone.")]


@pytest.mark.parametrize("most_rows, block, fan", [(4096, 2048, 64), (0, 2, 2), (3, 4, 3)])
def test_repair_of_odd_turns(spark, odd_turns, most_rows, block, fan):
    turns = spark.createDataFrame([(*r, "x", 1) for r in odd_turns], "conv_id long, turn long, role string, text string, conv string, part int").repartition(3)
    found = conversations.repair(turns, most_rows=most_rows, block=block, fan=fan).collect()
    assert plain(found) == plain(brute_repair(odd_turns))
    assert conversations.repair(turns.where("false")).count() == 0


def test_tree_of_matrices():
    rng = random.Random(6)
    for _ in range(50):
        parts = [conversations.turn_matrix(rng.choice("suaoxSUAO")) for _ in range(rng.randrange(1, 40))]
        left = parts[0]
        for p in parts[1:]:
            left = conversations.times(left, p)
        assert conversations.tree(parts) == left


def test_one_very_long_conversation(spark):
    turns = spark.range(30_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id") % 9000, F.lit(".")).alias("text"))
    whole, cut = (conversations.repair(turns, most_rows=n).collect() for n in (100_000, 1000))
    assert whole == cut and whole[0]["duplicate"] > 15_000


# Hard negatives


def brute_negatives(rows):
    held = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (a, label, v) in enumerate(held):
        if a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for k, (i, other, w) in enumerate(held) if k != at and len(w) == len(v)]
        for p, pid, _ in sorted(x for x in scored if x[2] == label)[:5]:
            inside = sorted(x for x in scored if x[2] != label and -50 * p <= -100 * x[0] <= -95 * p)[:3]
            out += [(a, pid, rank, n, -p, -s) for rank, (s, n, _) in enumerate(inside, 1)]
    return out


@pytest.mark.parametrize("sizes", [dict(), dict(chunk=3, anchor_rows=2, candidate_rows=7), dict(chunk=1, anchor_rows=1, candidate_rows=2)])
def test_hard_negatives_of_odd_rows(spark, sizes):
    rng = np.random.default_rng(7)
    rows = [(int(i), int(rng.integers(0, 3)), rng.normal(size=8).round(1).tolist()) for i in range(0, 400, 5)]
    rows += [(50, 1, [0.5] * 8)] * 3 + [(7, 1, [0.5] * 8)] * 4 + [(8, 2, [0.4] * 8)] * 4 + [(100, 0, [0.0] * 8), (150, None, [1.0] * 8), (200, 1, None), (None, 1, [1.0] * 8)]
    rows += [(250, 1, [float("nan")] * 8), (300, 1, [float("inf")] + [0.0] * 7), (301, 2, [None] + [1.0] * 7), (350, 1, []), (351, 1, []), (352, 0, []), (400, 1, [1.0, 2.0]), (401, 1, [2.0, 2.0]), (402, 2, [1.5, 1.5]), (450, 1, [1e6, -1e6]), (451, 1, [1e6, -1e6]), (452, 0, [7e5, -9e5])]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, rn string").repartition(3)
    found = negatives.hard_negatives(vectors, is_anchor=F.col("vec_id") % 50 == 0, **sizes).collect()
    want = brute_negatives(rows)
    assert plain(found) == plain(want) and {50, 100, 350, 400, 450} <= {r[0] for r in want} | {100}
    assert negatives.hard_negatives(vectors.where("false"), is_anchor=F.col("vec_id") % 50 == 0).count() == 0


def test_products_are_exact():
    rng = np.random.default_rng(8)
    a, b = rng.integers(-(2**30), 2**30, (3, 40)), rng.integers(-(2**30), 2**30, (4, 40))
    assert (negatives.product(a, b) == np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a])).all()
    for x in (np.zeros((2, 0)), a[:2], a[:2] // 2**20, a[:2] * 8):
        assert (negatives.wide(negatives.narrow(x.astype(np.int64)), 2) == x).all()


def test_large_scores_take_no_part(spark):
    rows = [(50, 1, [1e300]), (51, 1, [2.0]), (100, 1, [2.0]), (101, 2, [1.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert [tuple(r) for r in negatives.hard_negatives(vectors, is_anchor=F.col("vec_id") % 50 == 0).collect()] == [(100, 51, 1, 101, 512 * 512, 512 * 384)]


def test_odd_products():
    assert list(itertools.chain(negatives.best(np.array([5, 7, 7, 1]), np.array([4, 9, 2, 3]), np.array([True, True, True, False]), 2))) == [2, 1]


def test_tiles_stay_where_they_are_made(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), int(i) % 3, rng.normal(size=4).round(1).tolist()) for i in range(0, 300, 5)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = negatives.hard_negatives(vectors, is_anchor=F.col("vec_id") % 50 == 0, anchor_rows=2, candidate_rows=5)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    made = plan[plan.index("MapInPandas") :]
    assert "CartesianProduct" in made and "Exchange" not in made[: made.index("Scan")] and "FlatMapCoGroups" not in plan
    assert plain(found.collect()) == plain(brute_negatives(rows))
