"""Byte BPE, chat formatting, personal data, language, near-duplicates and search against plain models on small rows."""

import hashlib
import math
import random
import re
from collections import Counter as Tally
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from panelweave.llm import catalog, language_id, order_minhash, ranked_search
from panelweave.llm.byte_bpe import codec, decode_documents, digests, encode_documents
from panelweave.llm.chat_format import format_chats, loss_text, read_chat
from panelweave.llm.language_id import _backward, _forward, held_out, learn, predict, shared_out, train
from panelweave.llm.order_minhash import aligned, exact_keys, exact_limit, near_duplicates, needed, sketch_keys
from panelweave.llm.personal_data import Field, Shapes, active_runs, base_spans, luhn, redact, shape, spans_of
from panelweave.llm.personal_data import learn as learn_field
from panelweave.llm.common import WordHashes
from panelweave.llm.ranked_search import Index, bag, packed, search

from test_words import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
FOLDER = "/root/testdata/sf0.001"


def test_byte_bpe_equals_tiktoken_and_decodes(spark):
    own = codec(RANKS, public_tokenizers.PATTERN)
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", None, " \n\t  x", "<|endoftext|>", "a" * 5000, "🙂é日本", *("".join(rng.choice(a) for _ in range(n)) for a in ("ab", "abc  \n'sé", "etaoin", "0129") for n in (1, 7, 2000))]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(None, "ab", None)]
    got = {r.doc_id: r for r in digests(table(spark, rows), RANKS, public_tokenizers.PATTERN).collect()}
    for d, t, _ in rows:
        ids = model.encode_ordinary(t or "")
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = encode_documents(table(spark, rows), RANKS, public_tokenizers.PATTERN)
    data = {r.doc_id: bytes(r.data) for r in decode_documents(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert all(data[d] == (t or "").encode() for d, t, _ in rows)
    assert encoded.where(~F.col("exact")).isEmpty()
    assert digests(table(spark, []), RANKS, public_tokenizers.PATTERN).collect() == []


def test_chats_are_read_back(spark):
    marks = ["[INST] ", " [/INST]", "<s>", "</s>", "[SYS]", "[/SYS]", "[TURN]", "[/TURN]", "[TEXT]", "\\", "\\\\", "</", "s>", "x", "\n", "é", " "]
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            rows.append((c if c else None, rng.choice([t, t, None]), rng.choice(["user", "assistant", "system", "tool", None, "[TEXT]a\nb", ""]), rng.choice([None, "".join(rng.choice(marks) for _ in range(rng.randint(0, 9)))])))
    rows += rows[:3]
    rows += [(100, t, r, "k" * 200_000) for t, r in enumerate(["user", "assistant", "user"])] + [(101, 1, "system", "s"), (101, 2, "user", "u"), (101, 3, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = format_chats(df).select("conv_id", "formatted", "valid", read_chat(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss")).collect()
    chats = defaultdict(list)
    for c, t, r, x in rows:
        chats[c].append((t is not None, t or 0, r or "", x or ""))
    assert len(got) == len(chats)
    for g in got:
        want = [(r, x) for _, _, r, x in sorted(chats[g.conv_id])]
        assert [(t.role, t.text) for t in g.turns] == want
        assert g.loss == "".join(x for r, x in want if r == "assistant")
        roles = [r for r, _ in want]
        body = roles[1:] if roles[:1] == ["system"] else roles
        assert g.valid == (len(body) % 2 == 0 and len(body) > 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body)))
    assert format_chats(df.limit(0)).collect() == []


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    found = [[m.span() for m in re.finditer(p, text)] for p in PATTERNS]
    digits = lambda s: re.sub("[^0-9]", "", text[slice(*s)])
    found[1] = [s for s in found[1] if all(int(x) <= 255 for x in text[slice(*s)].split("."))]
    found[2] = [s for s in found[2] if 13 <= len(digits(s)) <= 19 and luhn(digits(s))]
    found[3] = [s for s in found[3] if 9 <= len(digits(s)) <= 15]
    return found


def test_patterns_equal_regular_expressions():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(["a", "1", "2", "@", ".", "-", "+", " ", "(", ")", "_", "é", "42", "4111111111111111", "%"]) for _ in range(rng.randint(0, 30)))
        assert base_spans(text) == plain_spans(text)
    for text in ("a" * 200_000 + "@", "1" * 100_000 + ".1" * 100_000, "+1" * 100_000, "@a" * 100_000):
        base_spans(text)


def test_field_decodes_the_best_path():
    rng = np.random.default_rng(2)
    field = Field({"9": 3, "9.9": 4})
    for w in (field.own, field.left, field.right, field.step):
        w += rng.normal(size=w.shape)
    import itertools

    for n in (1, 2, 4):
        ids = np.array([2, *rng.integers(0, 5, n), 2])[:, None]
        score = field.scores(ids)[:, 0]
        best = max(itertools.product(range(5), repeat=n), key=lambda p: sum(score[t, y] for t, y in enumerate(p)) + sum(field.step[a, b] for a, b in zip(p, p[1:])))
        assert tuple(field.decode(ids, np.array([n]))[:, 0]) == best


def test_personal_data_is_found_and_redacted(spark):
    rng = random.Random(5)
    filler = lambda: " ".join(rng.choice(["the", "of", "word", "item 12", "3.5", "and"]) for _ in range(12))
    kinds = [lambda: f"u{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: "4111111111111111", lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"]
    rows = [(d, f"{filler()} {kinds[d % 4]()} {filler()}" if d % 5 else filler(), "s") for d in range(200)]
    rows += [(500, None, None), (501, "", "s"), (None, "call (877) 555-5242 now", "s"), (502, "x " * 50_000 + "a@b.cd", "s"), (3, rows[3][1], "s")]
    docs = table(spark, rows)
    field = learn_field(docs)
    got = spans_of(docs, field, ["doc_id", "text"]).withColumn("red", redact(F.col("text"), F.col("spans"))).collect()
    assert len(got) == len(rows)
    names = ("email", "ip", "card", "phone")
    for r in got:
        want = [(k, s, e) for k, found in zip(names, plain_spans(r.text or "")) for s, e in found]
        assert [tuple(s) for s in r.base] == want and set(want) <= {tuple(s) for s in r.spans}
        out, at = "", 0
        for s, e, k in sorted((s.start, s.end, s.kind) for s in r.spans):
            if s >= at:
                out, at = out + (r.text or "")[at:s] + f"[{k.upper()}]", e
        assert r.red == (None if r.text is None else out + r.text[at:])
    clean = [r for r in got if r.doc_id is not None and r.doc_id < 200 and r.doc_id % 5 == 0]
    assert not any(r.spans for r in clean)
    assert spans_of(table(spark, []), learn_field(table(spark, []))).collect() == []


def test_shapes_are_of_whole_words():
    assert shape("x" * 64) == "" and shape("x" * 64 + "7") == "x9" and shape("é" * 100 + "@B.c") == "x@X.x"
    assert shape("-" * 70 + "+1") == "-" * 70 + "+9"
    shapes = Shapes({"x9": 3})
    words = ["near", "y" * 300 + "12", "near"]
    assert shape(words[1]) == "x99" and [shapes[w] for w in (*words, "y" * 65 + "1")] == [0, 1, 0, 3]
    ids = np.array([shapes[w] for w in words])
    assert [x.tolist() for x in active_runs(ids, np.zeros(3, int))] == [[0], [3]]


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    from panelweave.llm.language_id import Direction

    d = Direction(rng.normal(0, 0.3, (9, 256)), rng.normal(0, 0.3, (9, 3)), rng.normal(0, 0.3, (2, 3)))
    data, error = rng.integers(97, 100, (6, 4)), rng.normal(size=(6, 2, 4))
    loss = lambda: sum(float((error[t] * (d.score @ h)).sum()) for t, h in enumerate(_forward(d, data)[0][1:]))
    slopes = _backward(d, data, *_forward(d, data), error)
    for weights, slope in zip((d.table, d.recur, d.score), slopes):
        for at in [(0, 97), (4, 98), (8, 99)] if weights is d.table else [(0, 0), (1, 2)]:
            before = weights[at]
            weights[at] = before + 1e-5
            up = loss()
            weights[at] = before - 1e-5
            down = loss()
            weights[at] = before
            assert abs((up - down) / 2e-5 - slope[at]) < 1e-6


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(-1, None, "en"), (-2, "", "en"), (-3, "12 34 !", "en"), (-4, "x", None)]
    more = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = predict(more, learn(more, most_rows=400), ["doc_id", "lang", "text"]).withColumn("out", held_out(F.col("doc_id"))).collect()
    assert len(got) == docs.count() + 4
    said = {r.doc_id: r for r in got}
    assert all(said[d].lang_pred == "und" and said[d].score == 0 for d in (-1, -2, -3)) and said[-4].lang_pred != "und"
    tested = [r for r in got if r.out and r.doc_id >= 0]
    assert sum(r.lang == r.lang_pred for r in tested) >= 0.95 * len(tested) and all(0 <= r.score <= 1 for r in got)
    none = docs.limit(0)
    assert predict(none, learn(none)).collect() == []
    assert train(["only"], np.zeros(1, int), np.zeros((1, 8), np.uint8)).documents([b"abc"]).tolist() == [[1.0]]


def test_rare_languages_are_learned(spark, monkeypatch):
    assert [shared_out(c, 10) for c in ([], [3], [30], [1, 30], [2, 3, 4], [5, 5, 5], [4, 1, 90, 90])] == [0, 3, 10, 9, 4, 3, 3]
    seen = {}
    monkeypatch.setattr(language_id, "train", lambda languages, label, segments: seen.update(languages=languages, rows=Tally(label.tolist())))
    rows = [(d, f"text {d} of the first", "aa") for d in range(4000)] + [(d, f"some {d} other", lang) for d, lang in enumerate(["bb"] * 40 + ["cc"] * 12, 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn(docs, most_rows=60, pieces=1)
    free = Tally(r.lang for r in docs.where(~held_out(F.col("doc_id"))).collect())
    quota = shared_out(list(free.values()), 60)
    assert seen["languages"] == ["aa", "bb", "cc"] and seen["rows"] == Tally({k: min(quota, free[x]) for k, x in enumerate(["aa", "bb", "cc"])})
    many = spark.createDataFrame([(d, f"words of {d}", f"l{d % 90:02d}") for d in range(900)], docs.schema)
    learn(many, most_rows=400, pieces=1)
    assert len(seen["languages"]) == 90, "no language is left out while there are rows for it"
    learn(many, most_rows=30, pieces=1)
    assert len(seen["languages"]) == 30 and set(seen["rows"].values()) == {1}


def test_labels_of_held_out_rows_change_nothing(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "train", lambda languages, label, segments: seen.append((languages, label.tolist(), segments.tobytes())))
    rows = [(d, f"text {d} of these", ["aa", "bb", "cc"][d % 7 % 3]) for d in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("draw", "n", "cut0")})
    told = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    learn(docs, most_rows=90)
    learn(told, most_rows=90)
    assert seen[0] == seen[1] and seen[0][0] == ["aa", "bb", "cc"]


def classes(rows):
    """Components of multiset Jaccard of five-word shingles of 0.8 or more, or equal texts."""
    sets = [Tally(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").encode().split()) else None for _, t, _ in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if not same and sets[i] and sets[j]:
                met = sum((sets[i] & sets[j]).values())
                same = met >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - met)
            if same:
                parent[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(rows[i][0])
    name = {k: min((d for d in g if d is not None), default=None) for k, g in groups.items()}
    return Tally((rows[i][0], name[top(i)]) for i in range(len(rows)))


def test_near_duplicates_are_the_components(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "w" + str(rng.randint(0, 900))
    rows, number = [], iter(range(10_000))
    for size, edits in ((1, 0), (40, 3), (12, 6), (3, 1)):
        for _ in range(3):
            base = [word() for _ in range(180)]
            for _ in range(size):
                copy = list(base)
                for _ in range(rng.randint(0, edits)):
                    at = rng.randrange(len(copy))
                    copy[at : at + rng.randint(0, 1)] = [word()]
                rows.append((next(number), " ".join(copy), "s"))
    rows += [(next(number), "a b c", "s"), (next(number), "a  b c", "s"), (next(number), None, None), (next(number), "", "s"), (None, rows[5][1], "s"), (7, rows[7][1], "s")]
    rows += [(next(number), "same " * 300, "s"), (next(number), "same " * 310, "s"), (next(number), "same " * 900, "s")]
    got = near_duplicates(table(spark, rows))
    assert Tally(map(tuple, got.collect())) == classes(rows)
    assert near_duplicates(table(spark, [])).collect() == []
    monkeypatch.setattr(order_minhash, "GROUP_BYTES", 3000)
    monkeypatch.setattr(order_minhash, "BLOCK_SHINGLES", 700)
    assert Tally(map(tuple, near_duplicates(table(spark, rows)).collect())) == classes(rows)


def test_near_duplicates_of_short_texts(spark):
    rng = random.Random(12)
    words = lambda n: [f"u{rng.randint(0, 10**9)}" for _ in range(n)]
    rows, number = [], iter(range(10_000))
    for n in range(4, 19):
        for _ in range(8):
            base = words(n)
            for near in (base, base + words(1), words(1) + base, base[:-1] + words(1), words(1) + base + words(1)):
                rows.append((next(number), " ".join(near), "s"))
    rows += [(next(number), " ".join(["t1 t2 t3 t4 t5 t6 t7 t8", *words(1)]), "s") for _ in range(50)]
    assert Tally(map(tuple, near_duplicates(table(spark, rows)).collect())) == classes(rows)


def test_exact_keys_are_shared_by_all_near_sequences():
    rng = random.Random(13)
    assert exact_limit(0.8) == 13 and exact_limit(0.5) >= 6 and exact_limit(1.0) > 13
    for threshold, most in ((0.8, 13), (0.5, exact_limit(0.5))):
        met = 0
        for _ in range(3000):
            a = [rng.randint(0, 6) for _ in range(rng.randint(1, most))]
            b = list(a)
            for _ in range(rng.randint(0, 3)):
                at = rng.randint(0, len(b))
                b[at : at + rng.randint(0, 1)] = [rng.randint(0, 6)] * rng.randint(0, 1)
            if not 0 < len(b) <= most:
                continue
            a_, b_ = np.array(a, np.uint64), np.array(b, np.uint64)
            near = aligned(a_, b_, 40) >= needed(threshold, len(a), len(b))
            (own, others), (own_, others_) = exact_keys(a_, threshold), exact_keys(b_, threshold)
            shared = set(own) & {*own_, *others_} or set(own_) & {*others}
            assert bool(shared) == near
            met += near
        assert met > 500


def test_sketches_are_alike_in_steps(monkeypatch):
    marked, salts = np.random.default_rng(4).integers(0, 1 << 62, 500).astype(np.uint64), np.arange(1, 25, dtype=np.uint64)
    whole = sketch_keys(marked, 5, salts)
    monkeypatch.setattr(order_minhash, "STEP", 1700)
    assert (sketch_keys(marked, 5, salts) == whole).all()


def test_alignment_equals_the_table():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        assert aligned(np.array(a, np.uint64), np.array(b, np.uint64), 20) == row[-1]


def test_a_worker_forgets_what_the_step_before_remembered(spark):
    class Given:
        """A table whose ``mapInArrow`` gives the function that tasks would run."""

        schema = []
        select = lambda self, *columns: self
        mapInArrow = lambda self, fn, schema: fn

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two", "three"]})
    encode, label = encode_documents(Given(), RANKS, public_tokenizers.PATTERN), language_id.predict(Given(), language_id.Network([], None, None, None), ["doc_id", "text"])
    for step, left in ((encode, 1), (encode, 1), (label, 0), (encode, 1)):
        assert sum(b.num_rows for b in step(iter([batch]))) == 2 if step is encode else next(step(iter([])), None) is None
        assert codec.cache_info().currsize == left
        assert not left or len(codec(RANKS, public_tokenizers.PATTERN).known) == 3


def test_search_equals_scoring_all(spark):
    rng = random.Random(10)
    text = lambda n: " ".join(rng.choice(["The", "of", "A"]) if rng.random() < 0.4 else "t" + str(int(rng.expovariate(0.02))) for _ in range(n))
    rows = [(d, text(rng.randint(1, 60)), "s") for d in range(400)]
    rows += [(400, None, "s"), (401, "", "s"), (402, rows[3][1], "s"), (403, rows[3][1], "s"), (404, rows[4][1] * 300, "s"), (7, rows[7][1], "s")]
    asked = [(d, t) for d, t, _ in rows if d % 50 == 0] + [(999, "nowhere met"), (998, None)]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    got = defaultdict(list)
    for r in search(queries, table(spark, [*rows, (None, "of the", "s")]), shard_docs=90, pack_terms=60, wave_terms=200).collect():
        got[r.query_id].append((r["rank"], r.doc_id, r.score))
    bags = [(d, Tally((t or "").lower().split())) for d, t, _ in rows]
    mean = sum(sum(b.values()) for _, b in bags) / len(bags)
    often = Tally(w for _, b in bags for w in b)
    for q, t in asked:
        scored = []
        for d, bag in bags:
            score = sum(
                n * math.log(1 + (len(bags) - often[w] + 0.5) / (often[w] + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean))
                for w, n in Tally((t or "").lower().split()).items() if w in bag
            )
            if score:
                scored.append((-round(score, 8), d))
        assert [(d, -s) for s, d in sorted(scored)[:10]] == [(d, round(s, 8)) for _, d, s in sorted(got[q])]
    assert search(queries, table(spark, [])).collect() == []


def test_wand_starts_from_a_threshold_and_passes_over_blocks(monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK", 8)
    rng, hashes = random.Random(11), WordHashes()
    texts = [" ".join(f"l{d % 4}w{int(rng.expovariate(0.1))}" for _ in range(rng.randint(0, 40))).encode() for d in range(500)]
    bags = [bag(t, hashes) for t in texts]
    mean = sum(n for _, _, n in bags) / len(bags)
    index = Index(packed(np.arange(500), bags), mean, 1.2, 0.75)
    often = Tally(t for ts, _, _ in bags for t in ts.tolist())
    passed = 0
    for terms, counts, _ in bags[:60]:
        weights = counts * np.array([math.log(1 + (500 - often[t] + 0.5) / (often[t] + 0.5)) for t in terms.tolist()])
        own = dict(zip(terms.tolist(), weights.tolist()))
        plain = []
        for d, (ts, cs, n) in enumerate(bags):
            score = sum(own[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / mean)) for t, c in zip(ts.tolist(), cs.tolist()) if t in own)
            plain += [(-round(score, 9), d)] if score else []
        plain = sorted(plain)[:5]
        ids, scores = index.best(terms, weights, 5)
        assert [(-round(s, 9), d) for d, s in zip(ids.tolist(), scores.tolist())] == plain
        if len(plain) == 5:
            assert index.best(terms, weights, 5, scores[-1])[0].tolist() == ids.tolist()
            assert index.best(terms, weights, 5, scores[1] * (1 + 1e-6))[0].tolist() == [d for s, d in plain if -s > scores[1] * (1 + 1e-6)]
            most = index.top[np.searchsorted(index.terms, terms)] @ weights
            assert not len(index.best(terms, weights, 5, most * 1.01)[0])
            scored = []
            index.most, kept = _Counted(index.most, scored), index.most
            index.best(terms, weights, 5, scores[-1])
            index.most = kept
            passed += index.blocks - len(scored)
    assert passed > 60 * index.blocks // 4


class _Counted:
    """Block maxima that note how often they are looked up: once for each pivot block."""

    def __init__(self, values, seen):
        self.values, self.seen = values, seen

    def __getitem__(self, rows):
        self.seen.append(len(rows))
        return self.values[rows]


def test_search_reads_few_postings_of_common_terms():
    rng, hashes = random.Random(12), WordHashes()
    texts = [" ".join([rng.choice("abcdefgh") for _ in range(40)] + [f"r{rng.randrange(900)}" for _ in range(3)]).encode() for _ in range(600)]
    texts[50] = texts[51] = texts[7]
    bags = [bag(t, hashes) for t in texts]
    index, asked = Index(packed(np.arange(600), bags), 43.0, 1.2, 0.75), [(t, c * 0.5) for t, c, _ in bags[:40]]
    first = [index.best(t, w, 10) for t, w in asked]
    assert {7, 50, 51} == set(first[7][0][:3].tolist()) and len({*first[7][1][:3].tolist()}) == 1
    read = []
    index.weight = _Counted(index.weight, read)
    for (t, w), (ids, scores) in zip(asked, first):
        again = index.best(t, w, 10, scores[-1])
        assert again[0].tolist() == ids.tolist() and again[1].tolist() == scores.tolist()
    assert sum(read) * 4 < sum(int(np.isin(t, terms).sum()) for terms, _ in asked for t, _, _ in bags)


def test_every_query_row_is_answered(spark):
    docs = table(spark, [(d, f"a{d % 3} b{d % 5} c{d}", "s") for d in range(60)])
    answers = lambda rows: [(r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in search(spark.createDataFrame(rows, "query_id long, text string"), docs, k=4).collect()]
    alone = {t: [x[1:] for x in answers([(1, t)])] for t in ("a1 c7", "b2 b2", "a0")}
    rows = [(1, "a1 c7"), (1, "b2 b2"), (1, "a1 c7"), (2, "a1 c7"), (None, "a0"), (None, "b2 b2")]
    assert Tally(answers(rows)) == Tally((q, *x) for q, t in rows for x in alone[t])


def test_queries_have_their_columns(spark):
    want = {"op1": "doc_id n_words n_removed kept_sha256", "op3": "doc_id size source_size target taken", "op4": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op8": "doc_id n_tokens ids_sha256 decoded_sha256"}
    for name, fn in catalog.QUERIES.items():
        if columns := want.get(name.split("_")[0]):
            assert fn(spark, FOLDER).columns[: len(columns.split())] == columns.split()
