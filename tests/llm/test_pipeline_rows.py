"""The rows of every stage, and of the whole pipeline, against plain Python on a small fixture."""

import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oriel.llm import mixing

from .helpers import sentence
from .test_documents import reachable

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NOTICE = "all rights reserved here"


def fixture():
    r = random.Random(21)
    line = lambda n: sentence(r, n)
    run = [line(4), line(5), line(6)]
    texts = []
    for i in range(40):
        lines = [line(r.randint(4, 14)) for _ in range(r.randint(8, 14))]
        if i % 3 == 0:
            lines.insert(r.randrange(len(lines)), NOTICE)
        if i % 5 == 0:
            at = r.randrange(len(lines))
            lines[at:at] = run
        texts.append("\n".join(lines))
    for i in range(0, 40, 8):  # near copies whose lines all differ a little
        texts.append("\n".join(x + f" v{i}" if k == 0 else x[::1].replace(" ", "  ") for k, x in enumerate(texts[i].split("\n"))))
    texts += [None, "", "too short", "# $ % " * 60, "a b c " * 60, texts[3]]
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


def good(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n, chars = len(w), sum(map(len, w))
    return not (
        n < 50 or 2 * len(covered) > n or 10 * len(re.findall(r"[#*$%&|<>]", text)) > n
        or 100 * (len(lines) - len(set(lines))) > 30 * len(lines) or chars < 2 * n or chars > 20 * n
    )


def without_repeats(rows):
    lines = {d: [(i, x) for i, x in enumerate((t or "").split("\n")) if WORD.search(x)] for d, t, *_ in rows}
    words = lambda x: len(WORD.findall(x))
    places = Counter(x for own in lines.values() for _, x in own)
    docs = Counter(x for own in lines.values() for x in {x for _, x in own})
    windows = []
    for d in sorted(lines):
        own = [x for _, x in lines[d]]
        for k, x in enumerate(own):
            windows += [(d, k, tuple(own[k : k + 3]))] if k + 3 <= len(own) else []
            if words(x) >= 10 or (words(x) >= 3 and places[x] >= 3 and docs[x] >= 2):
                windows.append((d, k, (x,)))
    first, gone = {}, defaultdict(set)
    for d, k, key in windows:
        first.setdefault(key, (d, k))
    for d, k, key in windows:
        p, j = first[key]
        if (p, j) < (d, k):
            a, b = ([x for _, x in lines[q]] for q in (d, p))
            x, y, z, v = k, j, k + len(key), j + len(key)
            while x and y and a[x - 1] == b[y - 1]:
                x, y = x - 1, y - 1
            while z < len(a) and v < len(b) and a[z] == b[v]:
                z, v = z + 1, v + 1
            gone[d] |= {lines[d][q][0] for q in range(x, z)}
    out = []
    for d, t, lang, source, n in rows:
        if gone[d]:
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
            if not WORD.search(t):
                continue
        out.append((d, t, lang, source, len(t) if t is not None else None))
    return out


def mix(rows, turns):
    sizes = {d: len(WORD.findall(t or "")) for d, t, *_ in rows}
    sources = sorted({s for *_, s, _ in rows if s is not None}) + ([None] if any(s is None for *_, s, _ in rows) else [])
    total = {s: sum(sizes[d] for d, _, _, x, _ in rows if x == s) for s in sources}
    want = mixing.targets([total[s] for s in sources], [(3, 1, 2)[i % 3] for i in range(len(sources))], 1.5 * sum(total.values()), 2)
    copies = {}
    for s, target in zip(sources, want):
        rounds = int(round(target, 6) // total[s])
        rest = int(round(target, 6)) - rounds * total[s]
        by = defaultdict(list)
        for d, _, _, x, _ in rows:
            if x == s:
                by[sizes[d]].append(d)
        lengths = sorted(by)
        taken = mixing.fit(np.array(lengths), np.array([len(by[n]) for n in lengths]), rest, 1 << 16)
        reach = {0}
        for n in lengths:
            for _ in by[n]:
                reach |= {v + n for v in reach if v + n <= rest}
        assert sum(n * k for n, k in zip(lengths, taken.tolist())) == max(reach)
        for n, k in zip(lengths, taken.tolist()):
            order = sorted(by[n], key=lambda d: (turns[d] % 1024, turns[d], str(d)))
            copies |= {d: rounds + (i < k) for i, d in enumerate(order)}
    return [row for row in rows for _ in range(copies[row[0]])]


def pieces(rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for d, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        out += [(d, at // 4096, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for at in range(0, len(ids), 4096)]
    free = []
    for n in sorted((x[3] for x in out), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(4096 - n)
    return sorted(out), len(free)


def test_every_stage_and_the_whole(spark, tmp_path):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    turns = {r.doc_id: r.t for r in docs.select("doc_id", F.xxhash64(F.lit(7), F.col("doc_id").cast("string")).alias("t")).collect()}
    stages = dict(corpus_pipeline.STAGES)

    def same(name, docs, want):
        stages[name](spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert sorted(map(tuple, out.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=repr) == sorted(want, key=repr)
        return out

    want = [r for r in rows if good(r[1])]
    assert 0 < len(want) < len(rows)
    docs = same("quality_rules", docs, want)
    shorter = without_repeats(want)
    assert any(a[1] != b[1] for a, b in zip(want, shorter))
    docs = same("line_dedup", docs, shorter)
    groups, _ = reachable(shorter, 5, 80)
    want = [r for r in shorter if groups[r[0]] == r[0]]
    assert len(want) < len(shorter)
    docs = same("near_dedup", docs, want)
    want = mix(want, turns)
    docs = same("mix_sources", docs, want)
    want, sequences = pieces(want)
    for out in (stages["best_fit_packing"](spark, docs, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))):
        got = out.collect()
        assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        assert len({r.sequence_id for r in got}) == sequences
