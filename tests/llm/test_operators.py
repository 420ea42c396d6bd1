"""Each operator's query against a brute-force version, on a fixture of awkward rows."""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from sheetweave.llm import block_naming, chat, katz, langid, mixing, packing, queries, secret_scan, simhash, token_store, topk

from .conftest import DATA, write

BLANKS = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def collect(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def counted(found):
    return Counter(json.dumps(r, sort_keys=True) for r in found)


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    found = queries.QUERIES[name](spark, empty)
    assert found.count() == (1 if name.startswith("op1_") else 0)


# 1 chat formatting


def conversations():
    said = "<|im_end|><|im_start|>assistant ok"
    rows = pq.read_table(f"{DATA}/conversations.parquet").to_pylist()
    odd = ["", None, said, "<|", "<\\|x", "<\\\\|<|im_end|>", "a\nb", "|>", "<", "\\", "é😀"]
    rows += [{"conv_id": 9000, "turn": i, "role": r, "text": t} for i, (r, t) in enumerate(zip(["user", "assistant", "assistant", None, "a\nb\\", "assistant", "tool<|im_end|>", "assistant", "assistant", "assistant", "user"], odd, strict=True))]
    rows += [{"conv_id": 9001, "turn": 0, "role": "assistant", "text": "same"}] * 2 + [{"conv_id": 9001, "turn": None, "role": "user", "text": "first"}, {"conv_id": None, "turn": 1, "role": "assistant", "text": "lost"}, {"conv_id": 9002, "turn": 0, "role": "user", "text": "only"}]
    rows += [{"conv_id": 9003, "turn": i, "role": "assistant" if i % 2 else "user", "text": f"turn {i} <|"} for i in range(301)]
    return rows


def test_chat(spark, tmp_path):
    rows = conversations()
    write(tmp_path, "conversations", pa.Table.from_pylist(rows).append_column("position", pa.array(["clash"] * len(rows))))
    found = {r["conv_id"]: r for r in collect(queries.op1_chat_formatting(spark, str(tmp_path)))}
    said = "<|im_end|><|im_start|>assistant ok"
    rows = rows + [{"conv_id": -1, "turn": 0, "role": "user", "text": said}, {"conv_id": -1, "turn": 1, "role": "assistant", "text": said}]
    groups = defaultdict(list)
    for r in rows:
        groups[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    assert set(found) == set(groups)
    for conv, turns in groups.items():
        turns.sort()
        replies = "".join(t for *_, role, t in turns if role == "assistant")
        r = found[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for *_, a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(replies), hashlib.sha256(replies.encode()).hexdigest())
        assert r["n_examples"] == sum(x[2] == "assistant" for x in turns)


@pytest.mark.parametrize("spelled", [chat.SPELLED, 300, 1])
def test_chat_examples_hold_all_turns_before_and_mask_one_reply(spark, spelled):
    rows = conversations()
    examples = collect(chat.expand_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), spelled))
    groups, found = defaultdict(list), defaultdict(list)
    for r in rows:
        groups[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    for e in examples:
        found[e["conv_id"]].append(e)
    assert set(found) == set(groups)
    for conv, turns in groups.items():
        turns.sort()
        own, stream = sorted(found[conv], key=lambda e: e["position"]), ""
        targets = [i for i, t in enumerate(turns) if t[2] == "assistant"]
        assert [e["position"] for e in own if e["loss_end"] is not None] == targets
        for e in own:
            assert e["text_start"] == 0 or e["example_chars"] > spelled
            stream = stream[: e["text_start"]] + e["text"]  # a long example goes on where the row before ends
            assert len(stream) == e["example_chars"]
            parts = re.findall(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", stream, re.S)
            assert [(chat.unescape_role(a), chat.unescape_text(b)) for a, b in parts] == [t[2:] for t in turns[: e["position"] + 1]]
            if e["loss_end"] is not None:
                assert chat.unescape_text(stream[e["loss_start"] : e["loss_end"]]) == turns[e["position"]][3]
        assert own[-1]["position"] == len(turns) - 1


def test_long_examples_read_back_as_short_ones_do(spark):
    frame = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    assert counted(collect(chat.digest(chat.expand_examples(frame, 100)))) == counted(collect(chat.digest(chat.expand_examples(frame))))


# 2 exact top-k


@pytest.mark.parametrize("scale, block_bytes, rotated", [(1.0, 16_000_000, 2_048), (1e12, 16_000_000, 2_048), (1.0, 500, 2_048), (1.0, 16_000_000, 8)])
def test_top_k(spark, tmp_path, scale, block_bytes, rotated, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(topk, "MOST_ROTATED", rotated)
    rng = np.random.default_rng(3)
    rows = [{"vec_id": i, "embedding": (rng.normal(size=16) * scale * rng.lognormal()).tolist()} for i in range(1, 700)]
    rows += [{"vec_id": 1000 + i, "embedding": rows[49]["embedding"]} for i in range(300)]
    rows += [{"vec_id": 2000, "embedding": None}, {"vec_id": 2050, "embedding": [1.0, None]}, {"vec_id": 2100, "embedding": [float("nan")] * 16}, {"vec_id": 2150, "embedding": [float("inf")] * 16}, {"vec_id": 2200, "embedding": []}, {"vec_id": 2250, "embedding": [0.5, -0.3]}, {"vec_id": None, "embedding": [1.0] * 16}, {"vec_id": 2301, "embedding": [9.0] * 20}]
    rows += [rows[99], rows[120], rows[120]]
    rows = [r | {"id": "clash", "norm": "clash"} for r in rows]
    # longer than any query, with its length beyond what a query has
    rows += [{"vec_id": 2301 + i, "embedding": [0.01 * i] * 16 + [1e6] * 9, "id": "clash", "norm": "clash"} for i in range(3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, norm string").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = collect(queries.op2_exact_top_k(spark, str(tmp_path)))
    good = [(r["vec_id"], [math.floor(256 * x) for x in r["embedding"]]) for r in rows if r["vec_id"] is not None and r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    want = []
    for q, v in {(q, tuple(v)) for q, v in good if q % 50 == 0}:
        scores = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=False)), -(2**63)), 2**63 - 1), c) for c, w in good if c != q)[:5]
        want += [{"query_id": q, "rank": i + 1, "vec_id": c, "score": -s} for i, (s, c) in enumerate(scores)]
    assert counted(found) == counted(want)


# 3 mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / whole for s in free}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def test_mixing(spark, tricky, rows):
    found = collect(queries.op3_pareto_mixing(spark, tricky))
    assert counted(found) == counted(collect(queries.op3_pareto_mixing(spark, tricky)))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    want = targets(sizes)
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in found) == Counter((r["doc_id"], len(WORD.findall(r["text"] or "")), sizes[r["source"]]) for r in rows)
    assert all(r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in found)
    by_key = {(r["doc_id"], r["text"]): r["source"] for r in rows}
    largest = defaultdict(int)
    for r in rows:
        largest[r["source"]] = max(largest[r["source"]], len(WORD.findall(r["text"] or "")))
    taken, at = defaultdict(int), {}
    for r in found:
        taken[(r["source_size"], round(r["target"], 3))] += r["taken"]
    for s, t in want.items():
        assert abs(taken[(sizes[s], round(t, 3))] - t) <= largest[s] / 2 + 1e-6, s
    assert by_key and at == {}


@pytest.mark.parametrize("unit", ["words", "rows"])
def test_mixing_draws_a_fixed_size_with_unequal_chances(spark, unit):
    docs = spark.range(21_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'w w w w w w', 'w w') as text", "if(id < 1000, 'a', 'b') as source", "if(id % 2 = 0, 4.0, 1.0) as odds")
    found = collect(mixing.pareto_mix(docs, weights=(1, 2), odds_weight="odds", unit=unit))
    of_b = [r for r in found if r["doc_id"] >= 1000]
    target = of_b[0]["target"]
    # chances follow the odds: four times as many copies are expected of a heavy document, up to the most there are
    heavy, light = ([r for r in of_b if r["doc_id"] % 2 == k] for k in (0, 1))
    assert {round(r["expected"], 9) for r in heavy} == {round(min(3, 4 * r["expected"]), 9) for r in light}
    assert sum(r["expected"] * r["size"] for r in of_b) == pytest.approx(target)
    for some in (heavy, light):
        assert np.mean([r["copies"] for r in some]) == pytest.approx(some[0]["expected"], rel=0.03)
        assert {r["copies"] for r in some} <= {math.floor(some[0]["expected"]), math.floor(some[0]["expected"]) + 1}
    if unit == "rows":  # as many documents as the chances sum to
        assert sum(r["copies"] - math.floor(r["expected"] + 1e-12) for r in of_b) == round(sum(r["expected"] - math.floor(r["expected"] + 1e-12) for r in of_b))
    else:
        assert abs(sum(r["taken"] for r in of_b) - target) <= 3


def test_longer_documents_are_likelier_by_default(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id % 2 = 0, 'w', repeat('w ', 62)) as text", "if(id < 15000, 'a', 'b') as source")
    found = collect(mixing.pareto_mix(docs, weights=(1, 1)))
    rate = lambda k: np.mean([r["copies"] for r in found if r["doc_id"] < 15000 and r["doc_id"] % 2 == k])
    assert rate(1) / rate(0) == pytest.approx(6 / math.log2(3), rel=0.05)


def test_repeated_rows_follow_the_mix(spark, tricky, rows):
    docs = spark.read.parquet(f"{tricky}/documents.parquet")
    mixed = Counter()
    for r in collect(mixing.pareto_mix(docs)):
        mixed[r["doc_id"]] += r["copies"]
    found = mixing.repeat_rows(docs)
    assert found.columns == docs.columns
    assert Counter(r["doc_id"] for r in found.select("doc_id").collect()) == +mixed


# 4 LM scoring


def words_of(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return [*WORD.findall(low), "\n"]


class BruteKatz:
    """The model from all n-grams of the training documents, evaluated word by word."""

    def __init__(self, rows, order):
        self.order, self.count = order, [None, Counter()]
        training = [words_of(r["text"]) for r in rows if not katz.held_out(r["doc_id"], 7, 2)]
        for tokens in training:
            self.count[1].update(tokens)
        for n in range(2, order + 1):
            grams = Counter()
            for tokens in training:
                padded = ["\n", *tokens]
                grams.update(tuple(padded[i : i + n]) for i in range(len(padded) - n + 1))
            self.count.append(grams)
        seen = lambda c: np.array([sum(v == i for v in c.values()) for i in range(1, 7)], float)
        self.total, self.types = sum(self.count[1].values()), len(self.count[1])
        self.one = katz.Unigrams(seen(self.count[1]), self.total)
        self.uni = {w: float(self.one.p(np.array([c]))[0]) for w, c in self.count[1].items()}
        self.d, self.after, self.weights = {}, {}, {}
        for n in range(2, order + 1):
            self.after[n] = defaultdict(dict)
            for gram, c in self.count[n].items():
                if self.context(gram[:-1]):
                    self.after[n][gram[:-1]][gram[-1]] = c
            # discounts are from the n-grams whose contexts take part
            self.d[n] = katz.discounts(seen({(h, w): c for h, follow in self.after[n].items() for w, c in follow.items()}))
            for h, follow in self.after[n].items():
                low = [c for c in follow.values() if c <= 5]
                left = sum(c * (1 - self.d[n][c - 1]) for c in low)
                base = self.context(h) + (left <= 0)
                below = sum(self.p(h[1:], w) for w in follow)
                self.weights[h] = (base, (left if left > 0 else 1.0) / base / max(1 - below, 1e-300))

    def context(self, h):
        """Occurrences of a context that takes part, else 0."""
        c = self.count[1][h[0]] if len(h) == 1 else self.count[len(h)][h]
        return c if len(h) == 1 or c >= katz.LEAST_CONTEXT else 0

    def p(self, h, w):
        if not h:
            return self.uni.get(w, self.one.unknown)
        if h not in self.weights:
            return self.p(h[1:], w)
        base, alpha = self.weights[h]
        c = self.after[len(h) + 1][h].get(w, 0)
        return (self.d[len(h) + 1][c - 1] if c <= 5 else 1) * c / base if c else alpha * self.p(h[1:], w)

    def score(self, text):
        tokens = words_of(text)
        padded = ["\n", *tokens]
        return sum(math.log10(self.p(tuple(padded[max(0, i - self.order + 1) : i]), padded[i])) for i in range(1, len(padded)))


@pytest.mark.parametrize("order, hot, chunk_bytes", [(3, 300, 20_000), (3, 10**9, 10**7), (3, 1_000, 100), (2, 300, 20_000), (4, 300, 20_000), (1, 10, 20_000)])
def test_katz(spark, tricky, rows, order, hot, chunk_bytes):
    scores, model = katz.train_and_score(spark.read.parquet(f"{tricky}/documents.parquet"), order=order, hot=hot, chunk_bytes=chunk_bytes)
    brute = BruteKatz(rows, order)
    one = brute.one
    assert abs(sum(brute.uni.values()) + one.unknown - 1) < 1e-9
    some = list(brute.weights)
    for h in some[:100] + some[-300:]:  # probabilities after a context sum to 1
        whole = sum(brute.p(h, w) for w in brute.uni)
        unknown = brute.p(h, "\t not a word")
        assert abs(whole + unknown - 1) < 1e-9
    want = []
    for r in rows:
        tokens = words_of(r["text"])
        base = sum(math.log10((brute.count[1][t] + 1) / (brute.total + brute.types + 1)) for t in tokens)
        want.append((r["doc_id"], katz.held_out(r["doc_id"], 7, 2), len(tokens), sum(brute.count[1][t] > 0 for t in tokens), brute.total, base, brute.score(r["text"])))
    got = [tuple(r.values()) for r in collect(scores)]
    order_of = lambda x: (x[0] is None, x[0] or 0, x[2], x[5])
    for a, b in zip(sorted(got, key=order_of), sorted(want, key=order_of), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    for n in range(2, order + 1):  # the tables hold the model
        held = collect(katz.model_rows(model, n))
        assert Counter(round(r["p"], 12) for r in held) == Counter(round(brute.p(h, w), 12) for h, follow in brute.after[n].items() for w in follow)
        assert Counter(round(r["alpha"], 9) for r in held) == Counter(round(brute.weights[h][1], 9) for h, follow in brute.after[n].items() for _ in follow)


def test_katz_tells_documents_that_occur_twice_apart(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(300)]
    ids = [i for i in range(400) if not katz.held_out(i, 7, 2)][:200]
    texts = [" ".join(words[int(300 * x**3)] for x in rng.random(80)) for _ in ids]
    texts[100:150] = texts[:50]
    found = {r["doc_id"]: r["score"] for r in collect(katz.katz_scores(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")))}
    assert min(found[i] for i in ids[:50] + ids[100:150]) > max(found[i] for i in ids[50:100] + ids[150:])


def test_katz_beats_the_base_on_held_out_documents(spark):
    found = [r for r in collect(queries.op4_katz_backoff(spark, DATA.replace("0.001", "0.01"))) if r["held_out"]]
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


def test_katz_without_training_rows(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(60) if katz.held_out(i, 7, 2)], "doc_id long, text string")
    assert {(r["score"], r["base_score"], r["train_tokens"]) for r in collect(katz.katz_scores(docs))} == {(0.0, 0.0, 0)}


# 5 secrets


def base_spans(text):
    out = []
    assign = re.compile(r"""((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    fold = re.sub(r"[^\x00-\x7f]", "¶", text)  # of non-ASCII letters, none counts as a letter in either case
    for kind, pattern, group, least in (("assign", assign, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)):
        out += [(m.start(), ["assign", "access", "hex"].index(kind), m.end(), kind) for m in pattern.finditer(fold) if len(m[group]) >= least]
    return sorted(out)


def test_secret_scan(spark, tricky, rows):
    found = collect(queries.op5_secret_scan(spark, tricky))
    want = []
    for r in rows:
        spans = base_spans(r["text"] or "")
        n = Counter(s[3] for s in spans)
        spelled = ",".join(f"{k}:{a}:{e}" for a, _, e, k in spans)
        want.append((r["doc_id"], n["assign"], n["access"], n["hex"], hashlib.sha256(spelled.encode()).hexdigest()))
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in found) == Counter(want)
    assert any("random:" in r["spans"] for r in found if r["doc_id"] == 1026)
    assert sum("random:" in r["spans"] for r in found) <= 8


def made_strings(rng, n, alphabet, least=20, most=44):
    return ["".join(rng.choice(list(alphabet), rng.integers(least, most))) for _ in range(n)]


def test_models_tell_random_strings_from_identifiers(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    models = secret_scan.train(docs)
    size = len(secret_scan.ALPHABET) + 1
    assert models.recall > 0.97

    def mean(s):
        codes = [0, *(secret_scan.ALPHABET.find(c) + 1 for c in s)]
        return sum(models.ratio[a * size + b] for a, b in zip(codes, codes[1:], strict=False)) / len(s)

    rng = np.random.default_rng(1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for alphabet, least in ((upper + upper.lower() + "0123456789", 0.99), (upper + upper.lower(), 0.97), (upper + upper.lower() + "0123456789+/", 0.99), (upper.lower() + "0123456789", 0.97)):
        assert np.mean([mean(s) > models.threshold for s in made_strings(rng, 300, alphabet)]) > least, alphabet
    plain = [f"{a}_{b}_{c}_value" for a in secret_scan.PARTS[:6] for b in secret_scan.PARTS[20:26] for c in secret_scan.PARTS[40:45]]
    plain += ["internationalization", "Donaudampfschifffahrtsgesellschaft", "antidisestablishmentarianism", "getElementsByClassName", "12345678901234567890", "====================", "--------------------"]
    assert [s for s in plain if mean(s) > models.threshold] == []
    words = [s for r in docs.select("text").collect() for s in re.findall(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{20,}", r["text"] or "")]
    assert np.mean([mean(s) > models.threshold for s in words]) < 0.02


def test_random_strings_are_found_between_base_spans(spark):
    rng = np.random.default_rng(2)
    key, other = made_strings(rng, 2, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 30, 31)
    long = " ".join(f"token={i:06d}" for i in range(700))
    texts = [f"see qWzTkPvXbRmLcJhGfDsYnQwE there", f"{key}/password=hunter22x,{other}", f"é {key} É", long + " " + other, f"{key}" + "a" * 24]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    models = secret_scan.train(spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet"))
    found = {r["doc_id"]: [(secret_scan.KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"]] for r in secret_scan.scan(docs, models).collect()}
    assert found[0] == [("random", 4, 28)]
    assert found[1] == [("random", 0, 31), ("assign", 31, 49), ("random", 50, 80)]
    assert found[2] == [("random", 2, 32)]
    assert [s for s in found[3] if s[0] == "random"] == [("random", len(long) + 1, len(texts[3]))] and len(found[3]) == 701
    assert [s for i in found for s in found[i] if s[0] != "random"] == [(k, a, e) for t in texts for a, _, e, k in base_spans(t)]


# 6 token ids


def tokenized(name, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(queries.tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store(spark, tricky, rows):
    found = collect(queries.op6_token_store(spark, tricky))
    ids = [i + [0] for i in tokenized("byte_bpe_50k.json", [r["text"] or "" for r in rows])]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == Counter((r["doc_id"], len(i), crc(i)) for r, i in zip(rows, ids, strict=True))
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ordered = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert ordered == sorted(ordered, key=lambda k: (k is not None, k or 0))


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000, 20_000])
def test_perfect_hash_fills_every_slot_once_and_tells_absent_keys(n):
    rng = np.random.default_rng(n)
    ids = np.unique(rng.integers(-(2**62), 2**62, n))
    copies = rng.integers(-3, 3, len(ids))
    assert sorted(token_store.build_levels(ids, copies)[2].tolist()) == list(range(len(ids)))
    data = token_store.index_bytes(ids, copies, ids % 7, np.arange(len(ids)), ids % 5)
    index = token_store.Index(lambda at, size: data[at : at + size])
    found = index.find_all(ids, copies)
    assert (found["shard"] == ids % 7).all() and (found["at"] == np.arange(len(ids))).all() and (found["n"] == ids % 5).all()
    assert (index.find_all(ids, copies + 10)["n"] == -1).all()
    for i in range(0, len(ids), max(1, len(ids) // 50)):
        assert index.find(int(ids[i]), int(copies[i])) == (ids[i] % 7, i, ids[i] % 5)
        assert index.find(int(ids[i]), int(copies[i]) + 10) is None


def test_a_lookup_reads_no_more_of_a_larger_index():
    read = {}
    for n in (2_000, 200_000):
        ids = np.random.default_rng(1).permutation(n * 3)[:n]
        data = token_store.index_bytes(ids, np.zeros(n, np.int64), ids, ids, ids)
        sizes = []
        index = token_store.Index(lambda at, size, data=data, sizes=sizes: (sizes.append(size), data[at : at + size])[1])
        for i in ids[:200].tolist():
            assert index.find(i, 0) == (i, i, i)
        read[n] = sum(sizes)
    assert read[200_000] < 1.3 * read[2_000]


def test_token_store_finds_documents_by_key(spark, tricky, rows, monkeypatch, tmp_path):
    monkeypatch.setattr(token_store, "SHARD_IDS", 2_000)
    monkeypatch.setattr(token_store, "INDEX_KEYS", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = spark.read.parquet(f"{tricky}/documents.parquet")
    store = token_store.write_store(docs, queries.tokenizer_path("byte_bpe_50k.json"), folder=str(tmp_path / "store"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert store.n_buckets > 4 and store.n_shards > 3
    want = defaultdict(Counter)
    for r, ids in zip(rows, tokenized("byte_bpe_50k.json", [r["text"] or "" for r in rows]), strict=True):
        want[r["doc_id"]][tuple(ids + [0])] += 1
    for doc_id in [None, 3, 1000, 1026, *list(want)[:15]]:
        n = want[doc_id].total()
        assert Counter(tuple(store.document(doc_id, copy).tolist()) for copy in range(n)) == want[doc_id]
        assert store.document(doc_id, n) is None
    # an index that leads elsewhere gives other rows: nothing but the index finds a document
    asked = spark.createDataFrame([(3, 0), (999_999, 0), (3, 99)], "doc_id long, copy long")
    assert [r["doc_id"] for r in token_store.read_documents(store, asked).collect()] == [3]


# 7 exact dedup


def check_exact(found, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[BLANKS.sub(" ", r["text"] or "")].append(r["doc_id"])
    got = defaultdict(list)
    for r in found:
        got[r["text_sha256"]].append(r)
    assert len(found) == len(rows)
    for norm, ids in groups.items():
        own = got[hashlib.sha256(norm.encode()).hexdigest()]
        least = min((i for i in ids if i is not None), default=None)
        assert Counter(r["doc_id"] for r in own) == Counter(ids)
        assert {(r["keep_id"], r["group_size"]) for r in own} == {(least, len(ids))}
        assert [r["doc_id"] for r in own if r["kept"]] == [least]


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_exact_dedup(spark, tricky, rows, size):
    few = rows if size == 4096 else [r for r in rows if len(r["text"] or "") < 40 * size]
    docs = spark.read.parquet(f"{tricky}/documents.parquet") if size == 4096 else spark.createDataFrame(few, "doc_id long, text string, lang string, source string, n_chars long")
    check_exact(collect(block_naming.exact_groups(docs, size)), few)


def test_exact_dedup_names_again_where_hashes_collide(spark, rows):
    from pyspark.sql import functions as F

    tried = []

    def weak(salt):
        tried.append(salt)
        return (lambda b: F.struct(F.pmod(F.xxhash64(b), F.lit(3)).alias("h"), F.lit(0).alias("g"))) if salt == 0 else block_naming._hash(salt)

    check_exact(collect(block_naming.exact_groups(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), 64, weak)), rows)
    assert tried == [0, 2]


def test_drop_copies_keeps_one_row_of_each_text(spark, tricky, rows):
    docs = spark.read.parquet(f"{tricky}/documents.parquet")
    found = block_naming.drop_copies(docs)
    assert found.columns == docs.columns
    assert Counter(BLANKS.sub(" ", r["text"] or "") for r in found.collect()) == Counter({BLANKS.sub(" ", r["text"] or "") for r in rows})


# 8 language ID


def test_language_id(spark, tricky, rows):
    docs = spark.read.parquet(f"{tricky}/documents.parquet")
    filters = langid.learn(docs.where(~langid.in_fold(5, 0)))
    found = collect(queries.op8_language_id(spark, tricky))
    assert Counter((r["doc_id"], r["lang_pred"]) for r in found) == Counter((r["doc_id"], filters.predict(r["text"])[0]) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    und = {r["doc_id"] for r in rows if not re.search(r"[^\W\d_]", r["text"] or "")}
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und"} == und


def test_language_id_is_right_on_held_out_documents(spark):
    folder = DATA.replace("0.001", "0.01")
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    held = [r for r in collect(queries.op8_language_id(spark, folder)) if r["held_out"] and lang[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def plain_grams(text):
    """The n-grams as strings: blanks, digits and signs before the letters are one sign."""
    low = "".join(c if ord(c) >= 65 else " " for c in text.lower())
    low = low.ljust(langid.N)
    return [low[i : i + langid.N] for i in range(len(low) - langid.N + 1)]


def test_filters_say_what_exact_sets_say(spark):
    docs = [r for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist() if r["lang"] and r["text"]]
    filters = langid.learn(spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in docs], "doc_id long, text string, lang string"), sample_rows=10**9)
    known = {}
    for lang in sorted({r["lang"] for r in docs}):
        counts = Counter(g for r in docs if r["lang"] == lang for g in plain_grams(r["text"]))
        known[lang] = {g for g, n in counts.items() if n >= max(counts.total() * langid.LEAST_SHARE, 1)}
    assert filters.languages == sorted(known)
    other = [" ".join(r["text"].split()[:7]) for r in docs] + ["ab", "x", "Ünë tëxt", docs[0]["text"][:40] + docs[1]["text"][:40], "日本語のテキスト"]
    same = 0
    for text in [r["text"] for r in docs] + other:
        grams = plain_grams(text)
        exact = np.array([sum(g in known[x] for g in grams) / len(grams) for x in filters.languages])
        assert np.abs(filters.shares(text) - exact).max() <= 0.02 + 3 / len(grams)
        first, second = np.sort(exact)[::-1][:2]
        if first - second > 0.04 + 6 / len(grams):
            assert filters.predict(text)[0] == filters.languages[int(exact.argmax())]
            same += 1
    assert same > 0.8 * len(docs)


def test_long_texts_are_worked_on_in_slices_without_loss(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join(f"w{x}" for x in rng.integers(0, 500, 3_000))
    filters = langid.LanguageFilters(["a"], (rng.random((1, 1 << langid.SLOTS_LOG2)) < 0.5).astype(np.int64))
    whole = filters.shares(text), simhash.fingerprint(text, 3), simhash.wide_fingerprint(text, 5)
    monkeypatch.setattr(langid, "SLICE", 1_001)
    monkeypatch.setattr(simhash, "SLICE", 97)
    assert (filters.shares(text), simhash.fingerprint(text, 3), simhash.wide_fingerprint(text, 5)) == whole


def test_filters_over_more_than_63_languages(spark):
    alphabet = [chr(0x4E00 + i) for i in range(700)]
    docs = [(i, "".join(alphabet[7 * (i % 100) + (i * 3 + j * j) % 7] for j in range(60)), f"l{i % 100:03}") for i in range(400)]
    filters = langid.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert np.mean([filters.predict(t)[0] == x for _, t, x in docs]) > 0.98


# 9 packing


def check_packing(found, capacity):
    places = defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing(spark, tricky, rows):
    found = collect(queries.op9_packing(spark, tricky))
    want = []
    for r, ids in zip(rows, tokenized("word_bpe_49k.json", [r["text"] or "" for r in rows]), strict=True):
        ids = ids + [0]
        want += [(r["doc_id"], k // 2048, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])) for k in range(0, len(ids), 2048)]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == Counter(want)
    n = check_packing(found, 2048)
    assert n <= math.ceil(sum(x[3] for x in want) / 2048) * 1.05 + 2


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_length_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(4 + seed / 2, 1.0, 5000).astype(int) + 1, 1, 512)
    counts = Counter(lengths.tolist())
    planned = packing.plan(dict(counts), 512)
    used = Counter()
    for content, n in planned:
        assert sum(content) <= 512
        for x in content:
            used[x] += n
    assert used == counts
    bound = max(math.ceil(lengths.sum() / 512), int((lengths > 256).sum()))
    assert sum(n for _, n in planned) <= bound * 1.04 + 2


# 10 SimHash


def brute_print(text, shingle):
    words = WORD.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(prints):
    """Smallest id reachable, by union of all pairs within 3 bits."""
    distinct = list(dict.fromkeys(p for _, p in prints))
    parent = list(range(len(distinct)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for j in range(i):
            if (a ^ distinct[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    at = {p: root(i) for i, p in enumerate(distinct)}
    least = {}
    for d, p in prints:
        if d is not None:
            least[at[p]] = min(least.get(at[p], d), d)
    return Counter((d, f"{p:016x}", least.get(at[p])) for d, p in prints)


def test_simhash(spark, tricky, rows):
    few = [r for r in rows if len(r["text"] or "") < 3000]
    docs = spark.createDataFrame(few, "doc_id long, text string, lang string, source string, n_chars long")
    found = collect(simhash.near_groups(docs, shingle=3))
    assert Counter(tuple(r.values()) for r in found) == components([(r["doc_id"], brute_print(r["text"], 3)) for r in few])


@pytest.mark.parametrize("limit", [16, 4096])
def test_links_connect_exactly_what_is_within_the_radius(spark, limit, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", limit)
    rng = np.random.default_rng(limit)
    seeds = rng.integers(0, 2**63, 40).tolist()
    prints = set(seeds)
    for p in seeds:
        for _ in range(25):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                p ^= 1 << int(b)
            prints.add(p)
    prints |= {(seeds[0] & ~0xFFFF) | i for i in range(300)}  # one crowded half
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    edges = collect(simhash.links(spark.createDataFrame(signed, "fp long").repartition(7)))
    linked = [((e["a"] & (2**64 - 1)), (e["b"] & (2**64 - 1))) for e in edges]
    assert all((a ^ b).bit_count() <= 3 for a, b in linked)
    rows = [(i, p) for i, p in enumerate(sorted(prints))]
    want = components(rows)
    number = {p: i for i, p in rows}
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = root(number[a]), root(number[b])
        parent[max(x, y)] = min(x, y)
    assert Counter((i, f"{p:016x}", root(i)) for i, p in rows) == want


def test_bucket_links_divides_crowded_buckets_without_losing_links():
    rng = np.random.default_rng(8)
    prints = np.unique(rng.integers(0, 1 << 12, 900).astype(np.uint64) * np.uint64(0x10001))
    for limit in (8, 100_000):
        links = simhash.bucket_links(prints, np.ones(len(prints), bool), 3, limit)
        parent = list(range(len(prints)))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        got = Counter((i, f"{int(p):016x}", root(i)) for i, p in enumerate(prints))
        assert got == components([(i, int(p)) for i, p in enumerate(prints)])


def test_top_k_rotation_is_orthogonal(spark):
    vectors = topk.integer_vectors(spark.read.parquet(f"{DATA}/embeddings.parquet"), "vec_id", "embedding")
    q = topk._rotation(vectors, 64)
    assert np.allclose(q.T @ q, np.eye(64), atol=1e-9)


def similar_components(texts):
    """Smallest number of each text's component, by all pairs of five-word shingle sets at 0.8 or more."""
    sets = [set(simhash.shingle_set(x, 5).tolist()) for x in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("rows, hot", [(1_024, 4_096), (6, 4_096), (6, 2), (1_024, 2)])
def test_large_groups_in_parts_give_what_all_pairs_give(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", rows)
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(2_000)]
    texts = []
    for size, changes in ((40, 2), (25, 6), (15, 9)):  # groups of near, of borderline and of mostly too different copies
        base = rng.choice(words, 200).tolist()
        for _ in range(size):
            other = list(base)
            for at in rng.choice(200, changes, replace=False):
                other[at] = f"c{rng.integers(10**9)}"
            texts.append(" ".join(other))
    chain = rng.choice(words, 200).tolist()
    for _ in range(15):  # each near the one before, the last unlike the first
        chain = list(chain)
        for at in rng.choice(200, 3, replace=False):
            chain[at] = f"c{rng.integers(10**9)}"
        texts.append(" ".join(chain))
    texts += [" ".join(rng.choice(words, 200)) for _ in range(20)]
    rng.shuffle(texts)
    want = similar_components(texts)
    found = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == dict(enumerate(want))


def test_near_copies_go_and_other_documents_stay(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    docs, copies = [], set()
    for i in range(60):
        text = rng.choice(words, 300).tolist()
        docs.append((10 * i, " ".join(text), "x"))
        for j in range(3):
            other = list(text)
            for at in rng.choice(300, 4, replace=False):
                other[at] = "changed"
            docs.append((10 * i + j + 1, " ".join(other), "y"))
            copies.add(10 * i + j + 1)
    docs += [(5000 + i, " ".join(rng.choice(words, 2 + i % 9)), "z") for i in range(300)] + [(None, "no id", "z"), (9000, None, "z"), (9001, "", "z")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, low string")
    found = simhash.drop_near_copies(frame)
    assert found.columns == frame.columns
    kept = {r["doc_id"] for r in found.collect()}
    clean = {d for d, *_ in docs} - copies - {9001}
    assert clean <= kept and len(kept - clean) <= 0.02 * len(copies)


def near_pairs(rng, n, words=300):
    """Pairs of texts, and how many of them are of Jaccard similarity 0.8 to 0.83 over five words."""
    pool = [f"w{i}" for i in range(4000)]
    pairs = []
    while len(pairs) < n:
        text = rng.choice(pool, words).tolist()
        other = list(text)
        for at in rng.choice(words, 6, replace=False):
            other[at] = f"c{rng.integers(10**9)}"
        a, b = (set(zip(*(t[i:] for i in range(5)), strict=False)) for t in (text, other))
        if 0.8 <= len(a & b) / len(a | b) < 0.83:
            pairs.append((" ".join(text), " ".join(other)))
    return pairs


def test_every_pair_at_the_similarity_shares_a_key():
    rng = np.random.default_rng(8)
    for text, other in near_pairs(rng, 300):
        a, b = (simhash.shingle_set(t, 5) for t in (text, other))
        for common in (np.zeros(0, np.uint64), np.unique(rng.choice(a, 100)), np.union1d(a, b)):
            counts = rng.integers(1, 9, len(common))
            x, y = (simhash.prefix(g, 0.8, common, counts) for g in (a, b))
            assert set(x.tolist()) & set(y.tolist())
            assert len(x) <= 0.2 * len(a) + 1


def test_documents_below_the_similarity_stay(spark):
    rng = np.random.default_rng(9)
    pool = [f"w{i}" for i in range(4000)]
    docs, far = [], set()
    for i in range(120):
        text = rng.choice(pool, 300).tolist()
        other = list(text)
        for at in rng.choice(300, 9, replace=False):
            other[at] = f"c{rng.integers(10**9)}"
        a, b = (set(zip(*(t[j:] for j in range(5)), strict=False)) for t in (text, other))
        if 0.7 <= len(a & b) / len(a | b) < 0.79:
            docs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
            far.add(2 * i + 1)
    assert len(far) > 60
    pairs = near_pairs(rng, 60)
    docs += [(1000 + 2 * i + j, pair[j]) for i, pair in enumerate(pairs) for j in range(2)]
    kept = {r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {d for d, _ in docs if d < 1000 or d % 2 == 0}


def test_jaccard_links_connect_what_is_similar():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = [rng.choice(60, 25, replace=False) for _ in range(3)]
        sets = [np.unique(np.concatenate([b[rng.random(25) < 0.93], rng.choice(60, 1)])).astype(np.uint64) for b in base for _ in range(8)]
        near = lambda a, b: 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
        every = [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])]
        found = simhash.jaccard_links(sets, 0.8)
        assert all(near(sets[a], sets[b]) for a, b in found)

        def labels(edges, n=len(sets)):
            label = list(range(n))
            for a, b in edges:
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
            return label

        assert labels(found) == labels(every)


def test_near_copies_go_by_row_not_by_id(spark):
    rng = np.random.default_rng(10)
    (a, b), (c, d), (e, f), (g, h) = near_pairs(rng, 4)
    other = [" ".join(rng.choice([f"u{i}" for i in range(900)], 200)) for _ in range(4)]
    docs = [(1, a), (None, b), (None, other[0]), (None, other[1]), (3, c), (5, d), (5, other[2]), (7, e), (7, f), (None, g), (None, h), (9, other[3])]
    kept = Counter((r["doc_id"], r["text"]) for r in simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert kept[(7, e)] + kept[(7, f)] == 1 and kept[(None, g)] + kept[(None, h)] == 1
    sure = Counter([(1, a), (None, other[0]), (None, other[1]), (3, c), (5, other[2]), (9, other[3])])
    assert sure <= kept and kept.total() == sure.total() + 2


def test_language_stage_drops_what_no_language_knows_and_needs_labels(spark):
    from pyspark.sql import functions as F

    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, "zxqj kwvbt qqxz pfft wkjh zzgh", None), (-2, "日本語 テスト の 文章", None), (-3, "1 2 3", None)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, both, DATA).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}
    unlabelled = both.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    assert corpus_pipeline.language_id(spark, unlabelled, DATA).count() == both.count()


def test_stages_keep_columns_of_any_name_and_value(spark, tricky, rows):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tricky}/documents.parquet")
    values = {c: "clash" for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")}
    assert len(values) > 40
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, tricky)
        assert found.columns == docs.columns, name
        for r in found.select(*(f"`{c}`" for c in values)).distinct().collect():
            assert r.asDict() == values, name


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    docs = [{k: r[k] for k in ("doc_id", "text", "lang", "source", "n_chars")} for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()[:120]]
    for i, r in enumerate(docs[:40]):
        words = (r["text"] or "").split(" ")
        docs.append(dict(r) | {"doc_id": 1_000 + i, "text": "  ".join(words)})
        if len(words) > 80:
            words[40] = "changed"
            docs.append(dict(r) | {"doc_id": 2_000 + i, "text": " ".join(words)})
    docs += [{"doc_id": 3_000, "text": "zxqj kwvbt qqxz pfft wkjh zzgh", "lang": None, "source": "src1", "n_chars": 1}, {"doc_id": 3_001, "text": "1 2 3", "lang": None, "source": "src1", "n_chars": 1}, {"doc_id": 3_002, "text": None, "lang": "en", "source": "src1", "n_chars": 1}]
    rng.shuffle(docs)
    write(tmp_path, "documents", pa.Table.from_pylist(docs, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])))
    found = collect(corpus_pipeline.run(spark, str(tmp_path)))
    left = sorted((r for r in docs if r["doc_id"] < 3_000 and re.search(r"[^\W\d_]", r["text"] or "")), key=lambda r: r["doc_id"])
    first = {}
    for r in left:  # exact copies
        first.setdefault(BLANKS.sub(" ", r["text"]), r)
    left = sorted(first.values(), key=lambda r: r["doc_id"])
    label = similar_components([r["text"] for r in left])
    left = [r for i, r in enumerate(left) if label[i] == i]
    by_id = {r["doc_id"]: r for r in left}
    copies = Counter(r["doc_id"] for r in found if r["piece"] == 0)
    assert set(copies) <= set(by_id) and max(copies.values()) <= 3
    size = {d: len(WORD.findall(r["text"])) for d, r in by_id.items()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for d, r in by_id.items():
        sizes[r["source"]] += size[d]
        taken[r["source"]] += copies[d] * size[d]
    for source, want in targets(sizes).items():
        assert abs(taken[source] - want) <= max(size[d] for d, r in by_id.items() if r["source"] == source) / 2 + 1e-6
    want = Counter()
    for d, ids in zip(copies, tokenized("word_bpe_49k.json", [by_id[d]["text"] for d in copies]), strict=True):
        ids = ids + [0]
        for k in range(0, len(ids), 2048):
            want[(d, k // 2048, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048]))] += copies[d]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    assert check_packing(found, 2048) <= math.ceil(sum(r["length"] for r in found) / 2048) * 1.1 + 2


def test_pipeline_stages_keep_columns_and_take_effect(spark, tricky, empty):
    import corpus_pipeline

    for folder in (tricky, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns = docs.columns
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs
            docs = stage(spark, docs, folder)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == columns
                docs = spark.createDataFrame(docs.collect(), before.schema)
        found = collect(docs)
        check_packing(found, 2048)
        assert bool(found) == (folder == tricky)
    assert len(found) == 0


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_give_the_ids_of_whole_texts(name, spaced, small, monkeypatch):
    import random

    from sheetweave.llm import tokenization

    if small:
        for constant, value in (("REMEMBERED", 50), ("SLICE_BYTES", 3_000), ("SUB_BATCH", 7), ("WORDS", 3)):
            monkeypatch.setattr(tokenization, constant, value)
    rng = random.Random(1)
    atoms = [" ", "  ", "\n", "\n\n", "\n\n\n", "\t", "\r\n", "\x1f", "\x85", "\xa0", " ", "a", "B", "foo", "Bar", ".", ",", "...", "'s", "'", "don't", "é", "É", "é", "́", "1", "23", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "日本", "😀", "İ", "ß", "-", "\x00", "​", "x.y", "3.5", "a,b"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 25))) for _ in range(4_000)] + [""]
    texts += pq.read_table(f"{DATA}/documents.parquet", columns=["text"])["text"].to_pylist()
    got = []
    for _, _, ids, counts in tokenization.BatchEncoder(queries.tokenizer_path(name), spaced).slices(pa.array(texts)):
        got += [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == tokenized(name, texts)


def test_katz_contexts_that_occur_once_take_part(spark):
    """A held-out text goes on after a context that training has once as training does."""
    training = [i for i in range(60) if not katz.held_out(i, 7, 2)]
    held = [i for i in range(60) if katz.held_out(i, 7, 2)]
    texts = {i: f"a{i} b{i} c{i} d{i} b{i + 1} c e{i}" for i in training} | {i: f"a{j} b{j} {'c' if k % 2 else 'd'}{j}" for k, (i, j) in enumerate(zip(held, training, strict=False))}
    docs = [{"doc_id": i, "text": t} for i, t in texts.items()]
    brute = BruteKatz(docs, 3)
    scores, model = katz.train_and_score(spark.createDataFrame([(r["doc_id"], r["text"]) for r in docs], "doc_id long, text string").repartition(5), chunk_bytes=300)
    assert {r["doc_id"]: r["score"] for r in collect(scores)} == pytest.approx({r["doc_id"]: brute.score(r["text"]) for r in docs}, rel=1e-9)
    once = sum(brute.count[2][gram[:-1]] == 1 for gram in brute.count[3])
    found = collect(katz.model_rows(model, 3))
    assert once > 100 and len(found) == len(brute.count[3]) and sum(r["count"] for r in found) == brute.count[3].total()


def test_katz_asks_and_grams_of_lone_contexts_take_no_room_while_orders_are_merged(spark, tmp_path, monkeypatch):
    """Asks for words go when they are answered; n-grams after contexts that occur once are written with the scores only."""
    texts = [" ".join(f"w{(i * 7 + j * j) % 97} x{i}_{j}" for j in range(30)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    left, write = {}, katz.stash

    def seen(df, name="table", *by):
        folder = write(df, name, *by)
        parts = {f.rsplit("/", 1)[0] for f in folder.inputFiles()}
        left[name] = {f"{d.rsplit('/', 2)[1].rsplit('-', 1)[0]}/{d.rsplit('/', 1)[1]}" for d in parts}
        left[f"chunks at {name}"] = {p.name for top in tmp_path.glob("sheetweave/katz-chunks-*") for p in top.iterdir() if p.is_dir()}
        return folder

    monkeypatch.setattr(katz, "stash", seen)
    monkeypatch.setattr(katz, "fresh_path", lambda session, name: f"file://{tmp_path}/sheetweave/{name}-1")
    model = katz.train_and_score(docs, chunk_bytes=2_000)[1]
    assert left["chunks at katz-words"] == {"part=own", "part=asks"} and left["chunks at katz-merged-3"] == {"part=own"}
    assert not any(d.endswith("part=alone") for d in left["katz-merged-3"])
    assert left["katz-scores"] == {"katz-scores/part=scores", "katz-scores/part=alone-3"}
    assert model.alone[3].count() > 1


@pytest.mark.parametrize("values, kind", [([], np.uint64), ([0, 0, 0], np.uint32), ([1, 255], np.uint64), ([256, 3, 0], np.uint32), ([2**64 - 1, 0, 2**33], np.uint64), ([0.0, -1.5, 1e-300], np.float64), ([0, 1, 1], np.uint8)])
def test_katz_packed_numbers_come_back(values, kind):
    packed = katz.pack(np.array(values, kind), kind)
    assert katz.unpack(packed, kind).tolist() == values and katz.unpack(packed, kind).dtype == kind
    assert not values or packed[0] == {"f": 8}.get(np.dtype(kind).kind, max(1, -(-int(max(values)).bit_length() // 8)))


def test_balls_around_fingerprints_bring_near_copies_together_in_the_pipeline(spark, monkeypatch):
    """Without any candidate by shared shingles, near copies within the balls' radius go; a pair beyond it needs those."""
    import random

    import corpus_pipeline

    rng = random.Random(0)
    text = lambda n: [f"w{rng.randrange(5_000)}" for _ in range(n)]
    first, other = text(600), text(600)
    near = [*first[:-1], "changed"]
    far = [w if i % 50 else "changed" for i, w in enumerate(first)]
    bits = lambda a, b: (simhash.fingerprint(" ".join(a), 5) ^ simhash.fingerprint(" ".join(b), 5)).bit_count()
    assert bits(first, near) <= simhash.RADIUS < min(bits(first, far), bits(first, other))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([first, near, far, other])] + [(4, None), (5, "")], "doc_id long, text string")
    drop = lambda: sorted(r["doc_id"] for r in collect(corpus_pipeline.near_dedup(spark, docs, "")))
    assert drop() == [0, 3, 4]
    monkeypatch.setattr(simhash, "meeting_links", lambda keyed, radius: spark.createDataFrame([], "a string, b string"))
    assert drop() == [0, 2, 3, 4]


@pytest.mark.parametrize("text", [None, "", "a b", "a b c d e f a b c d e f a b c d e", "x " * 50])
def test_majority_of_hashes_is_the_fingerprint(text):
    assert simhash.majority(simhash.shingle_hashes(text, 5)) == simhash.fingerprint(text, 5)
