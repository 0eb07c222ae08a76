"""Row-wise text operators against brute force."""

import base64
import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sifter.llm import decontaminate, langid, lm, queries, secrets, tokens, words

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "/root/testdata/sf0.001"


def split(pattern, text):
    return re.findall(pattern, (text or "").translate(UPPER))


@pytest.mark.parametrize("piece", [1 << 20, 64, 7])
@pytest.mark.parametrize("pattern, table", [(r"[^\x20\x09-\x0D]+", words.WHITE_SPACE), (r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", words.NOT_ALNUM)])
def test_word_hashes_follow_the_word_rules(monkeypatch, piece, pattern, table):
    monkeypatch.setattr(words, "_PIECE", piece)
    rng = random.Random(1)
    texts = [None, "", "  ", "a", "ab A b", "É été"] + ["".join(rng.choice("aB É\n.1_Z\x00\x85") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    h, at = words.hashed_words(pa.array(texts), table)
    seen = {}
    for i, t in enumerate(texts):
        w = split(pattern, t)
        assert len(w) == at[i + 1] - at[i]
        assert all(seen.setdefault(x, y) == y for x, y in zip(w, h[at[i]:at[i + 1]].tolist()))
    assert len(set(seen.values())) == len(seen)


def test_automaton_counts_greedy_longest_matches():
    rng = random.Random(2)
    for _ in range(150):
        start, inner = ([("".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))) for _ in range(8)] for _ in range(2))
        a = tokens.Automaton(start, inner)
        for _ in range(100):
            w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            i = n = 0
            while i < len(w):
                j = next((j for j in range(len(w), i, -1) if w[i:j] in (start if i == 0 else inner)), None)
                if j is None:
                    n = 0
                    break
                i, n = j, n + 1
            assert a.count(w) == n


def test_token_counts_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "ab ab! zz"), (3, "ab ab! zz"), (None, "ab " * 50000), (5, "a" * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_text", F.lit("own"))
    got = tokens.token_counts(df, (["a", "ab", "!"], ["b", "a"]), cache_words=1).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, 0, 0, 0), (2, 0, 0, 0), (3, 4, 4, 1), (3, 4, 4, 1), (None, 50000, 50000, 0), (5, 1, 30000, 0)], key=str)
    assert tokens.token_counts(df.limit(0), (["a"], [])).count() == 0


def test_language_held_out_accuracy_and_rejection(spark):
    got = queries.op3_language_id(spark, DOCS.replace("0.001", "0.01")).join(
        spark.read.parquet(DOCS.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n, low, high = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 100 and right >= 0.97 and 0 <= low <= high <= 1
    langs = spark.createDataFrame([(i, t, l) for i in range(40) for t, l in (("the and of", "en"), ("der und die", "de"))], "doc_id long, text string, lang string")
    model = langid.learn(langs, F.lit(True))
    odd = spark.createDataFrame([(1, None), (2, "12 $$ !"), (3, "THE and"), (4, "und " * 200000)], "doc_id long, text string")
    rows = {r["doc_id"]: r["_langid"] for r in langid.identify(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und", "und", "en", "de"]
    assert rows[1]["score"] == rows[2]["score"] == 0 and not rows[1]["accepted"] and rows[4]["accepted"]
    nothing = langid.learn(langs.limit(0), F.lit(True))
    assert langid.identify(odd, nothing).where("_langid.accepted").count() == 0


def test_rejection_of_noise_and_of_an_unlearned_language(spark):
    docs = spark.read.parquet(DOCS.replace("0.001", "0.1") + "/documents.parquet").select("doc_id", "text", "lang").where("doc_id % 2 = 0 or lang != 'de'")
    new = F.col("lang") == "de"
    model = langid.learn(docs.where(~new), langid.fold("doc_id", 5) != 0)
    got = langid.identify(docs.where(langid.fold("doc_id", 5) == 0), model)
    clean, kept, unlearned, passed = got.agg(*[F.count_if(c) for c in (~new, ~new & F.col("_langid.accepted"), new, new & F.col("_langid.accepted"))]).first()
    assert clean > 1000 and kept >= 0.995 * clean
    assert unlearned > 100 and passed <= 0.1 * unlearned
    rng = random.Random(5)
    noise = [("".join(rng.choice(letters) for _ in range(rng.randint(60, 2000))),) for letters in (LATIN, "абвгдежзиклмнопр   ") for _ in range(100)]
    assert langid.identify(spark.createDataFrame(noise, "text string"), model).where("_langid.accepted").count() == 0


LATIN = "abcdefghijklmnopqrstuvwxyz     "


def test_a_rare_language_is_learned_at_every_size(spark):
    settings = langid.Settings(sample_rows=200, calibration_rows=100, language_rows=20)
    text = F.when(F.col("lang") == "el", "και το των " * 5).when(F.col("lang") == "de", "der und die " * 5).otherwise("the and of " * 5)
    for n in (500, 50000):
        docs = (spark.range(n).withColumnRenamed("id", "doc_id")
                .withColumn("lang", F.when(F.col("doc_id") < 5, "el").when(F.col("doc_id") % 3 == 0, "de").otherwise("en")).withColumn("text", text))
        model = langid.learn(docs, F.lit(True), settings)
        assert model.langs == ["de", "el", "en"]
        got = langid.identify(docs.where("doc_id < 50"), model).where("lang = _langid.lang_pred and _langid.accepted").count()
        assert got == 50
    only = docs.where("doc_id >= 5").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat("text", F.rand(1).cast("string")))
    assert langid.learn(only, F.lit(True), settings).langs == ["de", "en"]  # rows without id are drawn as well


def contaminated(docs, items, window):
    rx = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    out = []
    for d, text in docs:
        w, hit, ids = split(rx, text), set(), set()
        for i, t in items:
            v = split(rx, t)
            k = min(window, len(v))
            for p in range(len(v) - k + 1) if k else ():
                for q in range(len(w) - k + 1):
                    if w[q:q + k] == v[p:p + k]:
                        hit.update(range(q, q + k))
                        ids.add("" if i is None else str(i))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    return sorted(out, key=str)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = "a b c d É".split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 6, 9]) + 4)) for i in range(12)] + [(50, "b É"), (None, "d d d d d"), (51, None), (52, ""), (3, text(7))]
    docs = [(i, text(rng.randint(0, 60)).upper() if i % 3 else text(40)) for i in range(60)] + [(None, items[0][1]), (61, None), (62, ""), (1, items[2][1] * 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_found", F.lit("own"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for kw in ({}, {"block_bytes": 20}):
        found = decontaminate.find_matches(frame, bench, window=4, **kw)
        ids = decontaminate.item_ids(F.col("_matches"))
        got = found.select("doc_id", "_n_words", decontaminate.n_hit(F.col("_matches")), F.size(ids), F.sha2(F.array_join(ids, ",").cast("binary"), 256)).collect()
        assert sorted(map(tuple, got), key=str) == contaminated(docs, items, 4)
    assert decontaminate.remove_contaminated(frame, bench.limit(0)).count() == len(docs)
    assert decontaminate.find_matches(frame.limit(0), bench).count() == 0
    m = decontaminate.find_matches(spark.createDataFrame([(1, "x y z a b c d e f")], "doc_id long, text string"),
                                   spark.createDataFrame([(9, "q a b c d e w")], "item_id long, text string"), window=3).first()["_matches"]
    assert [tuple(x) for x in m] == [("9", 1, 3, 5)]  # one longest match with its place


def tlv(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82, n >> 8, n & 255])) + body


def test_structural_confirmation_of_keys_and_tokens():
    number = lambda n: tlv(2, (7).to_bytes(n, "big"))
    name = lambda b: len(b).to_bytes(4, "big") + b
    keys = [tlv(0x30, tlv(2, b"\0") + b"".join(map(number, (129, 3, 128, 65, 65, 64, 64, 64)))),
            tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"\x2b\x65\x70")) + tlv(4, tlv(4, b"k" * 32))),
            tlv(0x30, tlv(2, b"\1") + tlv(4, b"k" * 32) + tlv(0xA0, tlv(6, b"123"))),
            b"openssh-key-v1\0" + name(b"none") * 2 + name(b"") + (1).to_bytes(4, "big") + name(b"pub") + name(b"priv" * 20)]
    for key in keys:
        plain = base64.b64encode(key).decode()
        for t in (plain, key.hex(), "\n".join(plain[i:i + 64] for i in range(0, len(plain), 64))):
            assert ("key", 2, 2 + len(t)) in secrets.scan(f"x {t} y")
        assert not secrets.confirmed_spans(f"x {base64.b64encode(key[:-3]).decode()} y")
        assert not secrets.confirmed_spans(f"x {key[:-1].hex()} y")
    part = lambda v: base64.urlsafe_b64encode(json.dumps(v).encode()).decode().rstrip("=")
    good = f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.c2ln"
    assert secrets.scan(f"t {good}") == [("jwt", 2, 2 + len(good))]
    assert not secrets.confirmed_spans(f"t {part({'typ': 'x'})}.{part({'sub': 1})}.c2ln")
    assert not secrets.confirmed_spans("eyJhbGciOi.eyJ.abc")


def test_keys_of_every_length_in_armour_and_before_prose():
    name = lambda b: len(b).to_bytes(4, "big") + b
    pkcs8 = lambda n: tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"\x2b\x65\x70")) + tlv(4, tlv(4, b"\xfb" * n)))
    openssh = lambda n: b"openssh-key-v1\0" + name(b"none") * 2 + name(b"") + (1).to_bytes(4, "big") + name(b"pub") + name(b"p" * n)
    keys = [pkcs8(n) for n in range(32, 32 + 200)] + [openssh(n) for n in range(80, 80 + 200)]
    assert {len(k) % 48 for k in keys[:200]} == {len(k) % 48 for k in keys[200:]} == set(range(48))
    for key in keys:
        for encode in (base64.b64encode, base64.urlsafe_b64encode):
            plain = encode(key).decode()
            for brk in ("\n", "\r\n", "\\n", "\\r\\n", "\n  "):
                body = brk.join(plain[i:i + 64] for i in range(0, len(plain), 64))
                for before, after in ((f"-----BEGIN PRIVATE KEY-----{brk}", f"{brk}-----END PRIVATE KEY-----{brk}"), ("-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"),
                                      ("see ", f"{brk}Then some prose"), ('{"k": "', '"}'), ("", brk + body)):
                    spans = secrets.confirmed_spans(before + body + after)
                    assert spans[0] == ("key", len(before), len(before + body)), (len(key), before, brk)
                    assert len(spans) == 1 + after.endswith(body)
        cut = base64.b64encode(key[:-3 - len(key) % 3]).decode()  # what the armour line says doesn't fill a gap
        assert not secrets.confirmed_spans("\n".join(["-----BEGIN PRIVATE KEY-----", cut, "-----END PRIVATE KEY-----"]))
    key = base64.b64encode(pkcs8(32)).decode()
    assert secrets.confirmed_spans("MIIEMAAA\n" + key) == [("key", 9, 9 + len(key))]  # behind a start that fails
    assert secrets.confirmed_spans(f"{pkcs8(32).hex()}00ff") == [("key", 0, 2 * len(pkcs8(32)))]


def test_base_spans_equal_the_stated_patterns(spark):
    patterns = {"assign": (re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
                "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18), "hex": (re.compile("[0-9a-f]+"), 0, 16)}
    rng = random.Random(7)
    bits = ["password", "Secret", "api_key", "APIKEY", "toKen", "=", ":", " ", '"', "AKIA", "abcdef0123456789", "QWERTY123456789", "é", "x", "\n", "token="]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(300)] + [(300, None), (301, ""), (None, "a" * 100000), (5, "secret=" + "z" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_spans", F.lit("own"))
    got = secrets.find_secrets(df).select("doc_id", secrets.joined(secrets.base_only(F.col("_spans")))).collect()
    want = []
    for d, t in rows:
        spans = [(m.start(), k, m.end()) for k, (rx, g, least) in patterns.items() for m in rx.finditer(t or "") if len(m[g]) >= least]
        spans.sort(key=lambda s: (s[0], list(patterns).index(s[1])))
        want.append((d, ",".join(f"{k}:{a}:{b}" for a, k, b in spans)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_language_model_counts_equal_brute_force_and_interpolation_helps(spark):
    got = {r["doc_id"]: r for r in queries.op8_lm_scoring(spark, DOCS).collect()}
    texts = {r["doc_id"]: [*split(r"[^\x20\x09-\x0D]+", r["text"]), "\n"] for r in spark.read.parquet(DOCS + "/documents.parquet").select("doc_id", "text").collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 10 for i in texts}
    count = Counter(itertools.chain.from_iterable(t for i, t in texts.items() if fold[i]))
    n, v = sum(count.values()), len(count)
    for i, t in texts.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(w in count for w in t), n, fold[i] == 0)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_of_odd_rows_small_chunks_and_no_training_text(spark):
    rows = [(i, "a b a c" if i % 2 else "b a") for i in range(60)] + [(60, None), (None, "a zz"), (62, ""), (62, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    role = F.when(F.col("doc_id") % 3 == 0, lm.TUNED).otherwise(lm.FITTED)
    test = spark.createDataFrame([(100 + k, f"a {w}") for k, w in enumerate(["a", "b", "c", "zz"])] + [(99, "a")], "doc_id long, text string")
    scored = {r["doc_id"]: r for r in lm.score_texts(df.unionByName(test), F.when(F.col("doc_id") >= 99, lm.SCORED).otherwise(role), chunk_bytes=60).collect()}
    assert scored[60]["n_tokens"] == scored[62]["n_tokens"] == 1
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in scored.values())
    assert lm.score_texts(df.limit(0), role).count() == 0
    alone = lm.score_texts(test, F.lit(lm.SCORED)).first()
    assert alone["train_tokens"] == 0 and alone["n_known"] == 0


def test_language_scores_equal_a_plain_scorer(spark):
    """Subwords by loops, mean embedding and softmax by hand, for one given model."""
    def plain(text, m):
        code = [" ", *[c if c.isalpha() else " " for c in text.lower()], " "]
        grams = []
        for n in m.settings.orders:
            for i in range(len(code) - n + 1):
                g = code[i:i + n]
                letters = [c != " " for c in g]
                if (n == 1 and letters[0]) or (n == 2 and any(letters)) or (n == 3 and letters[1]):
                    h = 0
                    for c in g:
                        h = (h * 0x100000001B3 + ord(c)) % (1 << 48)
                    grams.append((((h + n) * 0x9E3779B97F4A7C15) % (1 << 64) >> 20) % m.settings.buckets)
        if not any(c != " " for c in code):
            return "und", 0.0
        z = [(math.fsum(float(m.scores[g][k]) for g in grams) / len(grams) + m.bias[k]) / m.temperature for k in range(len(m.langs))]
        e = [math.exp(x - max(z)) for x in z]
        best = max(range(len(z)), key=lambda k: (e[k], -k))
        return m.langs[best], e[best] / sum(e)

    docs = spark.read.parquet(DOCS + "/documents.parquet")
    model = langid.learn(docs, langid.fold("doc_id", 5) != 0)
    odd = [(-1, None), (-2, ""), (-3, "12 .,"), (-4, "É"), (-5, "x1y2 z"), (-5, "x1y2 z"), (-6, "mixed " * 500)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = langid.identify(rows, model).select("text", "_langid.*").collect()
    assert len(got) == docs.count() + len(odd)
    for r in got:
        lang, score = plain(r["text"] or "", model)
        assert (r["lang_pred"], r["score"]) == (lang, pytest.approx(score, abs=1e-5))


def test_language_model_scores_equal_plain_deleted_interpolation(spark):
    """Counts, expectation-maximisation over every held-out token, and the mixture, by loops."""
    texts = {r["doc_id"]: split(r"[^\x20\x09-\x0D]+", r["text"]) for r in spark.read.parquet(DOCS + "/documents.parquet").select("doc_id", "text").collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 10 for i in texts}

    def pairs(i):
        return list(zip(["<", *texts[i]], [*texts[i], "\n"]))

    def counts(use):
        single, double = Counter(), Counter()
        for i in texts:
            if use(fold[i]):
                double.update(pairs(i))
                single.update(w for _, w in pairs(i))
        single["<"] = single["\n"]  # a beginning per end; no word is called so
        return single, double, sum(c for w, c in single.items() if w != "<"), len(single) - 1

    def parts(u, w, c1, c2, n, v):
        return c2[u, w] / max(c1[u], 1), c1[w] / n, 1 / (v + 1)

    bucket = lambda c: min(int(math.log2(c + 1)), lm.BUCKETS - 1)
    fitted = counts(lambda f: f > 1)
    held = [(bucket(fitted[0][u]), parts(u, w, *fitted)) for i in texts if fold[i] == 1 for u, w in pairs(i)]
    weights = {b: (0.5, 0.4, 0.1) for b in range(lm.BUCKETS)}
    for _ in range(60):
        share = {b: [0.0, 0.0, 0.0] for b, _ in held}
        for b, p in held:
            mix = [x * y for x, y in zip(weights[b], p)]
            for k in range(3):
                share[b][k] += mix[k] / sum(mix)
        weights |= {b: tuple(x / sum(s) for x in s) for b, s in share.items()}
    seen = sorted(share)
    weights = {b: weights[min(seen, key=lambda s: (abs(s - b), s))] for b in range(lm.BUCKETS)}
    whole = counts(lambda f: f > 0)
    got = {r["doc_id"]: r["score"] for r in queries.op8_lm_scoring(spark, DOCS).collect()}
    for i in texts:
        want = math.fsum(math.log10(max(sum(x * y for x, y in zip(weights[bucket(whole[0][u])], parts(u, w, *whole))), 1e-300)) for u, w in pairs(i))
        assert got[i] == pytest.approx(want, rel=0.02, abs=0.05)


def test_repeated_windows_are_not_paired_and_give_the_longest_matches():
    """An item of equal words against a long text of them; and, on few words, the
    covered places, and every match verbatim and longer to neither side."""
    test = decontaminate.TestSuffixes([("line", "x " * 1000)], 10)
    assert len(test.low) == 1
    hashes, offsets = words.hashed_words(pa.array(["x " * 10_000, "y " + "x " * 25]), words.NOT_ALNUM)
    got = [x.tolist() for x in decontaminate.shard_matches(hashes, offsets, test)]
    assert sum(n for d, n in zip(got[0], got[4]) if d == 0) < 30_000 and len(got[0]) < 20
    assert (got[0][-1], got[3][-1], got[4][-1]) == (1, 1, 25)
    rng = random.Random(5)
    for _ in range(60):
        items = [[rng.choice("ab" if k % 2 else "abcdef") for _ in range(rng.randint(2, 30))] for k in range(4)]
        texts = [[rng.choice("abc") for _ in range(rng.randint(0, 40))] + items[k % 4][rng.randint(0, 3):] for k in range(5)]
        test = decontaminate.TestSuffixes([(str(k), " ".join(w)) for k, w in enumerate(items)], 4)
        hashes, offsets = words.hashed_words(pa.array([" ".join(t) for t in texts]), words.NOT_ALNUM)
        covered = {}
        for d, i, p, w, n in zip(*(x.tolist() for x in decontaminate.shard_matches(hashes, offsets, test))):
            t, s = texts[d], items[int(test.names[test.name_of[i]])]
            assert t[w:w + n] == s[p:p + n] and n >= min(4, len(s))
            if len(s) >= 4:
                assert not (w and any(s[q:q + n + 1] == t[w - 1:w + n] for q in range(len(s) - n)))
                assert not (w + n < len(t) and any(s[q:q + n + 1] == t[w:w + n + 1] for q in range(len(s) - n)))
            covered.setdefault((d, i), set()).update(range(w, w + n))
        for d, t in enumerate(texts):
            for i, s in enumerate(items):
                k = min(4, len(s))
                grams = {tuple(s[q:q + k]) for q in range(len(s) - k + 1)}
                want = {x for w in range(len(t) - k + 1) if tuple(t[w:w + k]) in grams for x in range(w, w + k)}
                assert covered.get((d, i), set()) == want
