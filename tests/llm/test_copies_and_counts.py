import zlib
from collections import Counter

import numpy as np
from cases import ODD, clashing, documents
from pyspark.sql import functions as F

from palaver.llm import exact_dedup, mixing, packing, token_counts, tokens

VOCABULARY = tokens.vocabulary("word_bpe_49k.json")


def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


# ---- exact dedup ---------------------------------------------------------------


def test_exact_groups_cases(spark):
    docs = clashing(documents(spark, ODD))
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(ODD) and sum(r["kept"] for r in got) == 8
    by = {r["doc_id"]: r for r in got}
    assert by[1]["keep_id"] == by[2]["keep_id"] == 2 and by[1]["group_size"] == 3
    assert by[3]["keep_id"] == by[4]["keep_id"] == 4
    assert by[5]["group_size"] == 1 and by[None]["keep_id"] is None and by[None]["group_size"] == 2
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == 8
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_collisions_are_chained_and_bytes_decide(spark):
    rows = [(i, f"text {i % 40}", "s") for i in range(120)]
    docs = documents(spark, rows)
    weak = lambda t: F.pmod(F.xxhash64(t), F.lit(4))
    one = lambda t: F.lit(7).cast("long")
    zero = lambda t: F.unhex(F.lit("00"))
    for options in ({"hash_of": weak}, {"hash_of": one}, {"hash_of": weak, "sha_of": zero}, {"hash_of": one, "sha_of": zero}, {"sha_of": zero}):
        got = exact_dedup.exact_groups(docs, capacity=3, **options).collect()
        assert sorted(r["doc_id"] for r in got) == list(range(120))
        assert all(r["group_size"] == 3 and r["keep_id"] == r["doc_id"] % 40 + 80 for r in got), options
        assert sorted(r["doc_id"] for r in got if r["kept"]) == list(range(80, 120))
    odd = exact_dedup.exact_groups(documents(spark, ODD), hash_of=one, sha_of=zero).collect()
    plain = exact_dedup.exact_groups(documents(spark, ODD)).collect()
    view = lambda rows: sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in rows)
    assert view(odd) == view(plain)


def test_groups_come_through_the_index(spark):
    """Owners chain the rows of a hash: links are numbered, and each link is in the bucket of its hash."""
    docs = documents(spark, [(i, f"text {i % 50}", "s") for i in range(200)])
    weak = F.pmod(F.xxhash64("text"), F.lit(3)) * (1 << 60)
    entries = docs.repartition(6).select("doc_id", weak.alias("hash"), F.unhex(F.sha2("text", 256)).alias("sha"), F.monotonically_increasing_id().alias("row"))
    index = exact_dedup.build_index(exact_dedup.materialise(entries, "test-entries"), capacity=5).collect()
    assert len(index) == 50 and sum(r["copies"] for r in index) == 200
    chains = {}
    for r in index:
        assert r["copies"] == 4 and r["id"] >= 150
        chains.setdefault((r["bucket"], r["hash"]), []).append(r["chain"])
    assert len(chains) == 3 and all(sorted(c) == list(range(1, len(c) + 1)) for c in chains.values())
    assert len({bucket for bucket, _ in chains}) == 3


def test_directory_doubles_until_buckets_fit():
    rng = np.random.default_rng(3)
    cells = sorted(Counter((rng.integers(0, 1 << 16, 3000) ** 2 >> 16).tolist()).items())
    directory = exact_dedup.Directory(100).fill(cells)
    assert len(directory.slots) == 1 << directory.depth
    held = Counter()
    for cell, n in cells:
        held[directory.slots[cell >> (16 - directory.depth)]] += n
    assert all(n <= 100 or directory.bits[b] == 16 for b, n in held.items())
    assert max(exact_dedup.Directory(10).fill([(5, 1000)]).bits) == 16  # one cell cannot be split further


# ---- tokens, packing, histogram --------------------------------------------------


def test_word_cache_equals_the_tokenizer(monkeypatch):
    monkeypatch.setattr(tokens, "KEEP", 50)
    whole, words = encoder(), tokens.Words(encoder())
    texts = [t for _, t, _ in ODD if t] + ["don't can't I'LL a<|endoftext|>b", "x=1;y=(2)", "İstanbul ΣΑΣ ΟΔΟΣ ﬁne", "'s 's.", "#$%", "éÉ é.,;"]
    for text in texts * 2:
        ids = np.frombuffer(tokens.encode(text, words), "<u4").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids, text[:40]


def test_packing_round_trip(spark):
    docs = clashing(documents(spark, ODD).repartition(2))
    pieces = packing.pack(docs, VOCABULARY, window=256, open_limit=3).collect()
    whole = encoder()
    expected = Counter()
    for i, t, _ in ODD:
        expected[i, zlib.crc32(np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())] += 1
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append(p)
    for held in windows.values():
        at = 0
        for p in sorted(held, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == 256 or at & (at - 1) == 0
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    for i in (1, 3, 4, 5, 6, 7, 8, 9):
        ids = whole.encode(dict((a, b) for a, b, _ in ODD)[i] or "", add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            part = np.array(ids[at: at + p["length"]], "<u4").tobytes()
            assert zlib.crc32(part) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids)
    assert sum(p["length"] for p in by_doc[2]) == 2 * by_doc[2][0]["doc_tokens"]
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0


def test_placement_minimises_the_sum_of_squares():
    rng = np.random.default_rng(1)
    packer = packing.SumOfSquares(lambda w: None, window=32, limit=10_000)
    for size in rng.integers(1, 32, 400):
        def total(level):
            n = packer.counts.copy()
            if level:
                n[level] -= 1
            n[level + size] += 1
            return int((n[1:32] ** 2).sum())
        choices = [0] + [h for h in range(1, 33 - size) if packer.counts[h]]
        assert total(packer.level_for(int(size))) == min(map(total, choices))
        packer.place(packing.Piece(0, 0, b"0000" * int(size), int(size)))


def test_length_histogram_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 8)
    rows = ODD + [(100 + k, "word " * (k % 23), "s") for k in range(60)]
    docs = clashing(documents(spark, rows))
    whole = encoder()
    lengths = [len(whole.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows]
    got = {r["encoded_length"]: r for r in token_counts.token_counts(docs, VOCABULARY).collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert r["docs"] == lengths.count(n) and r["docs_at_least"] == sum(x >= n for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert abs(r["share_up_to"] - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    hist = token_counts.length_histogram(docs, VOCABULARY)
    asked = spark.createDataFrame([(0,), (3,), (7,), (10**6,)], "context_limit long")
    for r in token_counts.at_limits(hist, asked).collect():
        assert r["truncated_total"] == sum(min(x, r["context_limit"]) for x in lengths)
    median = token_counts.quantile(token_counts.suffix_sums(hist), 0.5).first()[0]
    assert median == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.token_counts(docs.limit(0), VOCABULARY).count() == 0


# ---- mixing -----------------------------------------------------------------------


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(names)}
    stopped, target = set(), {}
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in stopped)
        rest = sum(weight[s] for s in names if s not in stopped)
        target = {s: most * sizes[s] if s in stopped else weight[s] * left / rest for s in names}
        over = {s for s in names if s not in stopped and target[s] > most * sizes[s]}
        if not over:
            return target
        stopped |= over


def test_mixing_targets_and_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "w " * int(rng.integers(0, 60)), ["a", "b", "c", "d", None, "é", "Z"][int(rng.integers(0, 7) ** 2 % 7)]) for k in range(500)]
    rows += ODD[:6] + [(k, "hot " * 9, "b") for k in range(1000, 1400)]
    docs = clashing(documents(spark, rows))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target = filled(dict(sizes))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 60
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.select("source", "text").collect():
        words[r["source"]] += len((r["text"] or "").split())
    assert words == taken
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_rows(docs.limit(0)).count() == 0


def test_mixing_of_texts_without_words(spark):
    docs = documents(spark, [(1, None, "a"), (2, "", "b")])
    assert [(r["taken"], r["target"]) for r in mixing.mix(docs).collect()] == [(0, 0.0)] * 2
