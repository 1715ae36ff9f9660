"""Document operators against brute force, on rows with every awkward value."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from oriel.llm import components, hyperminhash, linededup, mixing, packing, quality, substring
from oriel.llm.common import Workspace

from .helpers import corpus, empty, frame, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = corpus()


# near duplicates


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def reachable(rows, k, percent):
    sets = [(d, shingles(t, k)) for d, t, *_ in rows]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {d: root(d) for d in up}, dict(sets)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_match_brute_force(spark, k):
    want, sets = reachable(ROWS, k, 80)
    got = hyperminhash.near_duplicates(frame(spark, ROWS), hyperminhash.NearDup(k, 80)).collect()
    assert len(got) == len(ROWS) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(sets[r.doc_id]), r.doc_id == want[r.doc_id])


def test_a_large_group_keeps_links_that_its_smallest_member_lacks(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows, texts = [], []
    for i in range(300):
        w = list(base)
        for _ in range(r.choice([0, 2, 6, 12])):
            w[r.randrange(len(w))] = f"x{r.randrange(40)}"
        texts.append(" ".join(w))
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    want, _ = reachable(rows, 4, 80)
    got = hyperminhash.near_duplicates(frame(spark, rows, False), hyperminhash.NearDup(4, 80)).collect()
    assert {x.doc_id: x.component_id for x in got} == want


def test_near_duplicates_of_nothing(spark):
    assert hyperminhash.near_duplicates(empty(spark)).count() == 0


def test_estimates_are_corrected_for_collisions():
    r = np.random.default_rng(1)
    common, a, b = (np.unique(r.integers(0, (1 << 64) - 1, n, dtype=np.uint64)) for n in (800, 100, 100))
    x, y = np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))
    sig = hyperminhash.registers([x, y])
    est, used = hyperminhash.estimate(sig[:1], sig[1:], np.array([len(x)]), np.array([len(y)]))
    assert used[0] == hyperminhash.BUCKETS and abs(est[0] - 0.8) < 0.15
    apart = hyperminhash.registers([a, b])
    assert hyperminhash.estimate(apart[:1], apart[1:], np.array([100]), np.array([100]))[0][0] < 0.05


def test_keep_first_keeps_columns_and_null_ids(spark):
    out = hyperminhash.keep_first(frame(spark, ROWS), hyperminhash.NearDup(4, 80))
    assert out.columns == frame(spark, ROWS).columns
    ids = [r.doc_id for r in out.collect()]
    assert None in ids and 7 not in ids


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components.components(Workspace(spark, "t"), links).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 51: 50}


# packing


def test_packing_is_best_fit_and_whole(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = ROWS + [(100 + i, sentence(random.Random(i), 40 * i), "s") for i in range(12)]
    got = packing.pack(frame(spark, rows), packing.Packing(path, capacity=512)).collect()
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for d, t, *_ in rows}
    ids[None] = [*tok.encode("a row without an id " * 20, add_special_tokens=False).ids, 1]
    bins, copies = defaultdict(list), Counter(d for d, *_ in rows)
    copies[None] = 1
    sizes = Counter()
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.start == 512 * r.piece
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
        sizes[r.doc_id] += r.length
    assert all(sizes[d] == copies[d] * len(ids[d]) for d in ids)
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512
    # as many sequences as packing piece by piece gives
    free = []
    for n in sorted((r.length for r in got), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            i = min(fits, key=lambda i: free[i])
            free[i] -= n
        else:
            free.append(512 - n)
    assert len(bins) == len(free)


def test_best_fit_runs_cover_every_piece_once():
    r = random.Random(2)
    histogram = Counter(r.randint(1, 64) for _ in range(5000))
    runs = packing.best_fit(histogram, 64)
    fill = Counter()
    for length in histogram:
        own = sorted(x for x in runs if x[0] == length)
        at = 0
        for _, rank, n, first, per, offset in own:
            assert rank == at
            at += n
            for i in range(n):
                fill[first + i // per] += length
        assert at == histogram[length]
    assert max(fill.values()) <= 64


def test_packing_of_nothing(spark):
    assert packing.pack(empty(spark), packing.Packing(public_tokenizers.path("word_bpe_49k.json"))).count() == 0


# quality


def test_quality_measurements_match_brute_force(spark):
    got = quality.judge(quality.ledger(frame(spark, ROWS))).collect()
    texts = {d: t or "" for d, t, *_ in ROWS} | {None: "a row without an id " * 20}
    assert len(got) == len(ROWS) + 1
    for r in got:
        t = texts[r.doc_id]
        w = WORD.findall(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_ablations_agree_with_the_ledger(spark):
    entries = quality.judge(quality.ledger(frame(spark, ROWS))).collect()
    mask = quality.POLICIES["v1"]
    for r in quality.ablations(quality.ledger(frame(spark, ROWS))).collect():
        bit = quality.BIT[r.rule]
        assert r.n_failed == sum(bool(e.failure_bits & bit) for e in entries)
        assert r.n_failed_alone == sum(e.failure_bits & mask == bit for e in entries)
        assert r.n_kept_without == sum(e.failure_bits & mask & ~bit == 0 for e in entries)


def test_keep_good_keeps_rows_as_they_are(spark):
    df = frame(spark, ROWS)
    kept = {r.doc_id for r in quality.judge(quality.ledger(df)).where("kept").collect()}
    out = quality.keep_good(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == kept
    assert quality.keep_good(empty(spark)).count() == 0


# mixing


def test_mix_meets_targets_and_repeats(spark):
    df = frame(spark, ROWS)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda rows: sorted(((r.doc_id or -1), r.size, r.taken) for r in rows)
    assert key(got) == key(again)
    per = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        p = per[r.source]
        p[0] += r.taken
        p[1], p[2] = r.target, r.source_size
        assert 0 <= r.taken <= 2 * r.size
    names = sorted(k for k in per if k is not None) + [None]
    want = mixing.targets([per[n][2] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(p[2] for p in per.values()), 2)
    for n, t in zip(names, want):
        assert abs(per[n][1] - t) < 1e-6 and per[n][0] <= t + 1e-6
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_fit_finds_the_best_sum_and_keeps_to_counts():
    r = random.Random(4)
    for _ in range(60):
        lengths = np.array(sorted(r.sample(range(1, 30), 5)))
        counts = np.array([r.randint(1, 4) for _ in lengths])
        budget = r.randint(0, int((lengths * counts).sum()) + 5)
        taken = mixing.fit(lengths, counts, budget, 1 << 16)
        assert ((taken >= 0) & (taken <= counts)).all() and (lengths * taken).sum() <= budget
    # a budget far above the table still ends within it
    lengths, counts = np.arange(1, 4000), np.full(3999, 50)
    taken = mixing.fit(lengths, counts, 123_456_789, 1 << 12)
    assert (lengths * taken).sum() == 123_456_789


def test_targets_share_the_excess_again():
    assert mixing.targets([10, 100, 100], [3, 1, 2], 315, 2) == [20.0, pytest.approx(295 / 3), pytest.approx(590 / 3)]


# substrings


def test_substrings_match_brute_force(spark):
    rows = [r for r in ROWS if r[0] != 6] + [(6, ROWS[6][1], "s0")] * 2
    got = substring.substring_dedup(frame(spark, rows), keep_text=True).collect()
    texts = {d: (t or "").encode() for d, t, *_ in rows}
    first = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - 49):
            first.setdefault(texts[d][i : i + 50], d)
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        b = texts[r.doc_id]
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < r.doc_id:
                gone[i : i + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        assert bytes(r.kept) == kept and len(r.spans) == spans
    assert substring.substring_dedup(empty(spark)).count() == 0


def test_maximal_repeats_of_a_text():
    strings = [b"xabcabcy", b"zabcq", b"abca"]
    text = np.frombuffer(b"".join(strings), np.uint8)
    array = substring.SuffixArray(text, np.cumsum([len(s) for s in strings]), 3)
    ends = np.cumsum([len(s) for s in strings])
    got = {(bytes(text[r.starts[0] : r.starts[0] + r.length]), tuple(sorted(r.starts.tolist()))) for r in array.repeats()}
    places = lambda s: tuple(i for i in range(len(text)) if bytes(text[i : i + len(s)]) == s and not any(i < e < i + len(s) for e in ends))
    assert got == {(b"abc", places(b"abc")), (b"abca", places(b"abca"))}


# lines


def test_lines_match_brute_force(spark):
    rule = linededup.Winnow(3, 10)
    rows = [(d if d is not None else None, t) for d, t, *_ in ROWS]
    got = linededup.line_dedup(frame(spark, ROWS, null_id=False), rule).collect()
    lines = {d: [(i, x) for i, x in enumerate((t or "").split("\n")) if WORD.search(x)] for d, t in rows}
    windows = []
    for d in sorted(lines):
        own = [x for _, x in lines[d]]
        for k in range(len(own)):
            if k + 3 <= len(own):
                windows.append((d, k, tuple(own[k : k + 3])))
            if len(WORD.findall(own[k])) >= 10:
                windows.append((d, k, (own[k],)))
    first, gone = {}, defaultdict(set)
    for d, k, key in windows:
        first.setdefault(key, (d, k))
    for d, k, key in windows:
        p, j = first[key]
        if (p, j) < (d, k):
            a, b = ([x for _, x in lines[q]] for q in (d, p))
            x, y = k, j
            while x and y and a[x - 1] == b[y - 1]:
                x, y = x - 1, y - 1
            z, y = k + len(key), j + len(key)
            while z < len(a) and y < len(b) and a[z] == b[y]:
                z, y = z + 1, y + 1
            gone[d] |= {lines[d][q][0] for q in range(x, z)}
    for r in got:
        text = dict(rows)[r.doc_id]
        want = text if not gone[r.doc_id] else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[r.doc_id])
        assert r.text == want and r["__n_removed"] == len(gone[r.doc_id])
    assert sum(map(bool, gone.values())) >= 4
    assert linededup.line_dedup(empty(spark)).count() == 0
    assert linededup.line_dedup(frame(spark, ROWS)).count() == len(ROWS) + 1


def test_substring_partitions_are_bounded(spark, monkeypatch):
    """However many buckets there are, partitions stay few, and one that has several buckets and blocks gives the same rows."""
    buckets, blocks = substring.dealing(100 << 40)
    assert buckets > 10**7 and min(buckets, substring.MOST_PARTITIONS) == min(blocks, substring.MOST_PARTITIONS) == substring.MOST_PARTITIONS
    r = random.Random(12)
    passage = "".join(r.choice("abcdef ") for _ in range(70))
    rows = [(i, (passage if i % 3 else "") + "".join(r.choice("xyz") for _ in range(r.randrange(120)))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(substring.substring_dedup(docs).select("doc_id", "n_removed", "n_spans", "kept_sha256").collect())
    assert sum(w.n_removed > 0 for w in want) >= 59
    monkeypatch.setattr(substring, "MOST_PARTITIONS", 3)
    assert sorted(substring.substring_dedup(docs).select("doc_id", "n_removed", "n_spans", "kept_sha256").collect()) == want


def test_substring_blobs_follow_parts_not_buckets(spark, monkeypatch):
    """Many buckets are sent in few blobs, and give the rows that few buckets give."""
    assert substring.parts_of(6000) == (375, 16) and substring.parts_of(48) == (48, 1)
    r = random.Random(13)
    passages = ["".join(r.choice("abcdefgh ") for _ in range(r.randrange(50, 400))) for _ in range(40)]
    rows = [(i, "".join(r.choice(passages) + r.choice("xyz") * 3 for _ in range(12))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(substring.substring_dedup(docs).select("doc_id", "n_removed", "n_spans", "kept_sha256").collect())
    sent = []
    table = pa.table({"d": [i for i, _ in rows], "text": [t for _, t in rows]})
    monkeypatch.setattr(substring, "pack", lambda *c, own=substring.pack: sent.append(len(c[0])) or own(*c))
    for _ in substring._grams(substring.Repeats(), *substring.parts_of(800))(iter(table.to_batches(max_chunksize=30))):
        pass
    assert len(sent) <= 50  # not one for each of ten batches and each bucket
    monkeypatch.undo()
    monkeypatch.setattr(substring, "BUCKET_BYTES", 1 << 10)
    assert sorted(substring.substring_dedup(docs).select("doc_id", "n_removed", "n_spans", "kept_sha256").collect()) == want


def test_bands_carry_the_size_of_the_set():
    """No member of a bucket has to be joined with its class for it."""
    sets = [np.unique(np.random.default_rng(i).integers(0, 1 << 63, 40 + i, dtype=np.uint64)) for i in range(5)]
    sig = hyperminhash.registers(sets)
    columns = [pa.array([1, 1, 2, 2, 3]), pa.array(range(10, 15)), pa.array([0, 1, 0, 1, 0]), pa.array([len(x) for x in sets]), pa.array([x.tobytes() for x in sig], pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, names=["bucket", "rep", "comp", "n", "sig"])
    for run in (hyperminhash._bands, hyperminhash._wide_bands(0)):
        out = pa.Table.from_batches(run(iter([batch])))
        assert set(zip(out["rep"].to_pylist(), out["n"].to_pylist())) == {(10 + i, len(x)) for i, x in enumerate(sets)}
