"""Substring removal, mixing, quality votes and token counts against plain models on small rows."""

import hashlib
import random
import re
from collections import Counter as Tally

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from panelweave.llm.mixture import highest_quotients, mix_sources
from panelweave.llm.quality_votes import fit, judge
from panelweave.llm.substring_dedup import remove_repeats
from panelweave.llm.token_counts import Counter, count_tokens, rounded, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark, rows):
    """Rows of (doc_id, text, source) as documents with columns whose names clash with the operators' own."""
    full = [(d, t, None, s, None if t is None else len(t)) for d, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).withColumns({c: F.lit(7) for c in ("chunk", "shard", "node", "key", "size", "target", "score")})


def without_repeats(rows, width=13):
    first = {}
    last = 2**63 - 1
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, last), last if d is None else d)
    out = []
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (last if d is None else d):
                keep[i : i + width] = [False] * width
        out.append((d, len(w), len(w) - sum(keep), b" ".join(x for x, k in zip(w, keep) if k).decode()))
    return sorted(out, key=str)


def passages(seed, n):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(30)) for _ in range(4)]
    rows = []
    for d in range(n):
        parts = [" ".join(rng.choice(["x", "yy", "zé", "q q"]) + str(rng.randint(0, 400)) for _ in range(rng.randint(0, 60))) for _ in range(2)]
        rows.append((d, "\n".join([parts[0], rng.choice([*shared, "", shared[0] + "\t" + shared[0]]), parts[1]]), "s"))
    return rows


@pytest.mark.parametrize("chunk,piece", [(1 << 18, 1 << 20), (64, 128)])
def test_repeats_go_where_an_earlier_document_has_them(spark, chunk, piece):
    rows = [*passages(1, 40), (3, None, None), (None, passages(1, 2)[1][1], None), (None, "", None), (7, passages(1, 8)[7][1], "s")]
    got = remove_repeats(table(spark, rows), chunk_windows=chunk, slice_windows=piece)
    assert sorted(map(tuple, got.collect()), key=str) == without_repeats(rows)
    assert sum(r[2] for r in without_repeats(rows)) > 100


def test_one_very_long_text_and_no_text(spark):
    long = " ".join(str(i % 5000) for i in range(60_000))
    rows = [(1, "3 " + long, "s"), (2, long, "s")]
    got = {r.doc_id: r.n_removed for r in remove_repeats(table(spark, rows), chunk_windows=1024, slice_windows=4096).collect()}
    assert got == {1: 0, 2: 60_000}
    assert remove_repeats(table(spark, [])).collect() == []


def shares(sizes, most=3):
    """Targets by reshare: stop what is above its bound, share the rest by weight."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    stopped = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in stopped)
        open_ = sum(weight[s] for s in names if s not in stopped)
        rate = rest / open_ if open_ else 0
        over = {s for s in names if s not in stopped and rate * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in stopped else rate * weight[s] for s in names}
        stopped |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_targets_and_repeats(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", "é", None, "big"]
    rows = [(d, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 80))), rng.choice([*names, "big", "big", "big"])) for d in range(400)]
    rows += [(400, None, "a"), (401, "", "b"), (402, "one two", "tiny"), (402, "one two", "tiny")]
    docs = table(spark, rows)
    got = mix_sources(docs, shard_docs=64).collect()
    size = Tally()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    want, taken = shares(size), Tally()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s, target in want.items():
        assert taken[s] == pytest.approx(target, rel=0.05, abs=1)
    again = mix_sources(docs.repartition(7), shard_docs=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mix_sources(table(spark, [])).collect() == []


@pytest.mark.parametrize("small,words,many", [(200, 3, 60_000), (2, 1, 30_000), (30, 40, 9_000)])
def test_small_sources_beside_a_large_one_get_their_share(spark, small, words, many):
    rows = [(d, "w " * 100, "large") for d in range(many // 100)]
    rows += [(1000 + k, "x " * words, f"s{k:03d}") for k in range(small)]
    got = mix_sources(table(spark, rows), shard_docs=100).collect()
    want = shares(Tally({"large": many, **{f"s{k:03d}": words for k in range(small)}}))
    taken = Tally()
    for r in got:
        taken[r.source] += r.taken
    assert all(taken[s] == pytest.approx(target, rel=0.1, abs=1) for s, target in want.items())


def test_seats_equal_plain_highest_quotients(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        votes = [rng.choice([0, 1, 3, 3, rng.randint(1, 5000)]) for _ in range(rng.randint(1, 9))]
        rows += [(g, k, v, rng.choice([0, 1, 7, 400]) if k == 0 else None) for k, v in enumerate(votes)]
    seats = {g: n for g, k, _, n in rows if k == 0}
    votes = spark.createDataFrame([(g, k, v, seats[g]) for g, k, v, _ in rows], "g int, k int, v long, n long")
    got = {(r.g, r.k): r.quota for r in highest_quotients(votes, ["g"], "v", "n", [F.col("k")]).collect()}
    for g, n in seats.items():
        rivals = {k: v for x, k, v, _ in rows if x == g and v}
        won = Tally()
        for _ in range(n if rivals else 0):
            won[min(rivals, key=lambda k: (-rivals[k] / (2 * won[k] + 1), k))] += 1
        assert {k: got.get((g, k), 0) for k in rivals} == {k: won[k] for k in rivals}


def base_counts(text):
    text = text or ""
    words, seen, doubles = text.encode().split(), set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            doubles += line in seen
            seen.add(line)
    often = Tally(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if often[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), len(re.sub(r"[\x20\x09-\x0D]", "", text)), len(re.findall(r"[#*$%&|<>]", text)), doubles, len(covered)


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(4)
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 200))) + ".\nEnd of it."
    good = [(d, prose(), "s") for d in range(200)]
    table_like = [(d, " | ".join(prose().split()), "s") for d in range(200, 215)]
    odd = [(300, None, None), (301, "", "s"), (302, "\n \n\n", "s"), (303, "same words again and again are not good " * 40, "s"), (304, "a b é \v\f x\r\ny", "s"), (None, prose(), "s"), (5, good[5][1], "s")]
    rows = [*good, *table_like, *odd]
    got = judge(table(spark, rows)).collect()
    want = Tally((d, *base_counts(t)) for d, t, _ in rows)
    assert Tally((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[d] for d, *_ in good)
    assert not any(kept[d] for d in [*range(200, 215), 300, 301, 302, 303])
    assert judge(table(spark, [])).collect() == []


def test_fit_trusts_rules_by_what_they_say():
    import numpy as np

    votes = np.array([[1, 1, 1], [-1, 0, 1], [-1, -1, 0], [0, 0, 0]])
    share, says = fit(votes, np.array([900.0, 40.0, 50.0, 10.0]))
    assert 0.5 < share <= 0.8 and says[0, 0, 1] > says[0, 0, 0]


def test_token_counts_equal_the_tokenizers(spark):
    scores = {p: rounded(s) for p, s in vocabulary(PIECES).items()}
    rng = random.Random(6)
    texts = ["", "Hello  world", " é ñ 日本 🙂\n", "x" * 3000, "".join(rng.choice("ab cd\nthe") for _ in range(500)), None]
    model = Tokenizer(models.Unigram([("<unk>", min(scores.values())), *scores.items()], unk_id=0))
    want = []
    for t in texts:
        marked = "▁" + t.replace(" ", "▁") if t else ""
        found = model.encode(marked)
        want.append(sum(1 if i else len(marked[a:b].encode()) for i, (a, b) in zip(found.ids, found.offsets)))
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(None, "Hello  world", None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in count_tokens(table(spark, rows), PIECES).collect())
    assert [n for *_, n in got] == [*want, want[1]]
    assert count_tokens(table(spark, []), PIECES).collect() == []


def test_ties_go_to_the_longer_last_piece():
    rng = random.Random(2)
    for _ in range(200):
        scores = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): rng.choice([-1.0, -2.0, -1.5]) for _ in range(8)}
        text = "".join(rng.choice("abc") for _ in range(25))
        model = Tokenizer(models.Unigram([("<unk>", -9.0), *scores.items()], unk_id=0))
        found = model.encode("▁" + text)
        want = sum(1 if i else len(("▁" + text)[a:b].encode()) for i, (a, b) in zip(found.ids, found.offsets))
        assert Counter(scores).count(text)[0] == want


def test_kept_words_digest(spark):
    rows = [(1, "a b", "s"), (2, None, "s")]
    got = remove_repeats(table(spark, rows)).select("doc_id", F.sha2(F.col("kept").cast("binary"), 256).alias("h"))
    assert {r.doc_id: r.h for r in got.collect()} == {1: hashlib.sha256(b"a b").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
