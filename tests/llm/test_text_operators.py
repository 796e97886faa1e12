"""Each text operator against a brute-force version, with nulls, empty and long texts, repeats and extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from weftline.llm import bpe, common, decontaminate, fingerprint, graph, langid, nearcopies, ngram, phrases, pii, pretoken, quality, registry, simhash, textops, tokenfile  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid int, fp string, key int"
R = random.Random(7)


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 2) for i, t in zip(ids, texts)], SCHEMA)


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


WORDS = ["alpha", "Beta", "gamma", "délta", "eps", "zeta", "eta", "x1"]
TEXTS = [" ".join(R.choice(WORDS) for _ in range(R.randrange(1, 60))) for _ in range(40)]
TEXTS += [TEXTS[0], TEXTS[0] + " tail", None, "", " \n\t", "one", "One", "a" * 5000, "word " * 3000, "é" * 300]


def test_words_and_hashes():
    data = np.frombuffer("ab  c\nde".encode(), np.uint8)
    s, e, row = textops.words(data, np.array([0, 2, 8]))
    assert [bytes(data[i:j]) for i, j in zip(s, e)] == [b"ab", b"c", b"de"] and row.tolist() == [0, 1, 1]
    h = textops.span_hash(textops.prefix_hash(np.frombuffer(b"xyzxyz", np.uint8)), np.array([0, 3, 1]), np.array([3, 6, 4]))
    assert h[0] == h[1] != h[2]
    assert list(textops.slices(np.array([0, 5, 30, 31]), 10)) == [(0, 1), (1, 2), (2, 3)]
    offsets, raw = textops.column_bytes(pa.array(["a", None, "bc"]).slice(1))
    assert offsets.tolist() == [0, 0, 2] and raw.tobytes() == b"bc"


def test_fingerprints_against_brute_force(spark):
    texts, ids = TEXTS, [3 * i + 1 for i in range(len(TEXTS))]
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, texts[::-1], ids[::-1])).collect()}
    assert sorted(got) == ids
    for n, i in enumerate(ids):
        text, after = texts[n] or "", texts[(n + 1) % len(texts)] or ""
        k = len(text) // 4
        new = text[: len(text) - k] + after[:k]
        r = got[i]
        own, changed, following = (fingerprint.codes(np.frombuffer(x.encode(), np.uint8)) for x in (text, new, after))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.digest(own), fingerprint.digest(changed))
        assert r.near_edited == fingerprint.likeness(own, changed) and r.near_next == fingerprint.likeness(own, following)
        assert 0 <= r.near_next <= 1


def test_digest_parses_and_counts_triplets():
    data = np.frombuffer(b"hello world, hello", np.uint8)
    parts = fingerprint.codes(data)
    back = fingerprint.parse(fingerprint.digest(parts))
    assert back[:2] == parts[:2] and (back[2] == parts[2]).all()
    assert fingerprint.bucket_counts(data).sum() == sum(len(data) - c for _, _, c in fingerprint.TRIPLETS)
    assert fingerprint.likeness(parts, parts) == 1


def test_fingerprints_of_repeated_and_null_ids(spark):
    rows = fingerprint.fingerprints(frame(spark, ["b", "a", "c"], [1, 1, None])).collect()
    assert len(rows) == 3 and [r.doc_id for r in rows].count(None) == 1
    assert fingerprint.fingerprints(frame(spark, [])).count() == 0


def quality_data(spark):
    good = [" ".join(R.choice(WORDS) for _ in range(30)) for _ in range(120)]
    bad = [" ".join(R.choice(WORDS) + "***" for _ in range(30)) for _ in range(60)]
    docs = frame(spark, good + bad + [None, "", "***"])
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)] + [(5, None, 0), (None, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_on_held_out_rows(spark):
    docs, labels = quality_data(spark)
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == 183 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    known = [r for r in rows if r.doc_id < 180]
    assert np.mean([r.predicted == int(r.doc_id < 120) for r in known if r.held_out]) > 0.95


def test_quality_of_few_labels_and_of_long_texts(spark):
    """Classes that share no word are told apart by as few rows as there are, however long they are."""
    good, bad = "calm river stone", "buy now cheap"
    for times in (1, 9000):
        texts = [f"{good} {i} " * times if i % 2 else f"{bad} {i} " * times for i in range(12)]
        labels = spark.createDataFrame([(i, i % 2, 9) for i in range(12)], "doc_id long, quality int, score int")
        rows = quality.scored(frame(spark, texts), labels).collect()
        assert len(rows) == 12 and all(r.predicted == r.doc_id % 2 and abs(r.score - 0.5) > 0.1 for r in rows)


def test_quality_ratios_descent_and_scores_against_brute_force():
    """Features, ratios, one pass of the dual descent and scores, recomputed a row at a time."""
    texts, y = [t for t in TEXTS[:30] if t], np.array([i % 2 for i in range(30)])
    slots = {}
    for a, n, row, slot in quality.features(pa.array(texts)):
        for i in range(n):
            slots[a + i] = slot[row == i]
    rows = [slots[i] for i in range(30)]
    good, bad = np.zeros(quality._SLOTS), np.zeros(quality._SLOTS)
    for r, label in zip(rows, y):
        assert len(set(r.tolist())) == len(r)  # indicators, each once
        for s in r:
            (good if label else bad)[s] += 1
    ratio = quality.log_ratio(good, bad)
    share = good.sum() / (good.sum() + bad.sum())
    for s in rows[0][:20]:
        assert abs(ratio[s] - math.log((good[s] + 2 * share) / (bad[s] + 2 * (1 - share)) * (1 - share) / share)) < 1e-12
    assert (ratio[(good + bad) == 0] == 0).all()
    w, b = quality.descend(rows, y, ratio, rounds=400)
    x = np.zeros((30, quality._SLOTS))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
    sign = np.where(y > 0, 1.0, -1.0)
    slack = np.maximum(0, 1 - sign * (x @ w + b))
    assert np.abs(w - (2 * slack * sign) @ x).max() < 1e-2 and abs(b - (2 * slack * sign).sum()) < 1e-2  # the loss is stationary there
    model = quality.Model(ratio, w, b)
    assert np.allclose(model.scores(pa.array(texts)), 1 / (1 + np.exp(-3 * (x @ w + b))), atol=1e-5)


def test_quality_without_labels(spark):
    docs, labels = quality_data(spark)
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(docs.limit(0), labels).count() == 0


def test_dual_descent_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    w, b = quality.descend(rows, np.array([1, 1, 0, 0]), np.array([1.0, -1.0, 0.1, 0.1]))
    assert all(((w[r] @ np.array([1.0, -1.0, 0.1, 0.1])[r] + b) > 0) == (n < 2) for n, r in enumerate(rows))


def dedup_brute(texts):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(raw[i : i + 100])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return out


def test_phrases_against_brute_force(spark):
    base = ["".join(R.choice("abc dé") for _ in range(R.randrange(600))) for _ in range(15)]
    mixed = [R.choice(base)[R.randrange(50) :][:250] + R.choice(base)[R.randrange(90) :][:300] for _ in range(50)]
    texts = base + mixed + [None, "", "a" * 900, "a" * 900, "ab" * 300, "q" * 99, "r" * 100, "r" * 101]
    got = [tuple(r)[1:] for r in sorted(phrases.result(frame(spark, texts)).collect())]
    assert got == dedup_brute(texts)


def test_phrases_with_repeated_and_null_ids(spark):
    text = "".join(R.choice("abcdefgh ") for _ in range(300))
    rows = phrases.result(frame(spark, [text, text, text], [4, 4, None])).collect()
    assert sorted(r.n_removed for r in rows) == [0, 300, 300]
    assert next(r for r in rows if r.doc_id is None).n_removed == 0
    assert phrases.result(frame(spark, [])).count() == 0


def test_every_window_is_in_one_phrase():
    texts = [b"", b"x" * 99, b"y" * 100, bytes(R.randrange(97, 100) for _ in range(700)), b"z" * 400]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    row, s, m, _, _ = phrases.parse(data, offsets)
    for n, t in enumerate(texts):
        starts = np.concatenate([np.arange(a, a + b) for a, b in zip(s[row == n], m[row == n])] or [np.zeros(0, int)])
        assert starts.tolist() == list(range(max(0, len(t) - 99)))


def hits_brute(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall(lowered(t))
        n = min(len(w), 10)
        for a in range(len(w) - n + 1) if n else ():
            windows[tuple(w[a : a + n])].add(i)
    for t in docs:
        w, hit, found = word.findall(lowered(t)), set(), set()
        for n in range(1, 11):
            for a in range(len(w) - n + 1):
                if own := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    found |= own
        yield len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(str(x) for x in found)).encode()).hexdigest(), bool(hit)


def test_decontamination_against_brute_force(spark, monkeypatch):
    items = [(i, " ".join(R.choice(WORDS) for _ in range(n))) for i, n in enumerate([12, 15, 10, 9, 3, 1, 30])]
    items += [(2, "alpha beta gamma zeta eta x1 alpha beta gamma zeta eta"), (9, None), (10, "!!"), (11, items[0][1])]
    docs = TEXTS + [f"so {items[0][1].upper()} and, {items[6][1][20:]}!", items[3][1] * 1, "alpha " * 400]
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, words int")
    want = list(hits_brute(docs, items))
    assert [tuple(r)[1:] for r in sorted(decontaminate.result(frame(spark, docs), bench).collect())] == want
    monkeypatch.setattr(decontaminate, "BROADCAST_FINGERPRINTS", 0)  # the way for large benchmarks
    assert [tuple(r)[1:] for r in sorted(decontaminate.result(frame(spark, docs), bench).collect())] == want
    clean = decontaminate.decontaminated(frame(spark, docs), bench)
    assert clean.columns == SCHEMA.replace(",", " ").split()[::2] and clean.count() == sum(not w[4] for w in want)
    assert decontaminate.result(frame(spark, docs), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.result(frame(spark, []), bench).count() == 0


@pytest.mark.parametrize("fingerprints", [0, 200_000])
def test_decontamination_of_words_whose_lower_case_depends_on_what_follows(spark, monkeypatch, fingerprints):
    monkeypatch.setattr(decontaminate, "BROADCAST_FINGERPRINTS", fingerprints)
    long, short = "one two three ΛΟΓΟΣ five six seven eight nine ten", "ΟΔΟΣ İstanbul 5\u212a"
    items = [(0, long), (1, short), (2, "ΣΑΣ")]
    docs = [long.replace("ΛΟΓΟΣ ", "ΛΟΓΟΣ" + sign) for sign in (".", "'", ":", ",", " ", "\n")] + [short.replace("ΟΔΟΣ ", "ΟΔΟΣ" + sign) for sign in ".':,"]
    docs += ["x " + short, short.upper(), short.lower(), "ΣΑΣ", "ΣΑΣ.β", "β ΣΑΣ", "σας", "ΣΑΣ'Σ ΣΑΣ", "5k 5K 5\u212a", long.lower()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = list(hits_brute(docs, items))
    assert [tuple(r)[1:] for r in sorted(decontaminate.result(frame(spark, docs), bench).collect())] == want
    assert [w[1] for w in want[:6]] == [10] * 6


def test_decontamination_of_null_and_repeated_ids(spark):
    items, docs = [(0, "alpha beta gamma")], ["so alpha beta gamma", "nothing", "Alpha, Beta: Gamma!", "so alpha beta gamma", None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.result(frame(spark, docs, [None, None, 4, 4, 4]), bench)
    want = [(i, *w) for i, w in zip([None, None, 4, 4, 4], hits_brute(docs, items))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sorted(str(r.doc_id) for r in decontaminate.decontaminated(frame(spark, docs, [None, None, 4, 4, 4]), bench).collect()) == ["4", "None"]


ALPHABET = list("abcdstABC'  \n\t'!9٣é漢ß  .-ll re ve") + ["'s", "'re", "<|endoftext|>", "<|startoftext|>", "  ", "\x1c", "\r\n", "​", "\U0001f600", "İ", "Σ", "é", "Ⅳ"]
FUZZ = ["".join(R.choice(ALPHABET) for _ in range(R.randrange(40))) for _ in range(1200)]


def test_bpe_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, merges = Tokenizer.from_file(path), bpe.Merges(path)
    texts = [*FUZZ, *(t or "" for t in TEXTS), "<|endoftext|>" * 2, " " * 500]
    words = sorted({w.encode() for t in texts for w in t.split(" ")[:3]})
    encoder = bpe.Encoder(path, bpe.build_automaton(list(zip(words, merges.encode(words)))))
    for n, row in encoder.column(pa.array(texts)):
        want = library.encode(texts[n], add_special_tokens=False).ids
        assert [i for x in row for i in x[0]] == want
        assert b"".join(x[2] for x in row).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_automaton_shares_suffixes_and_finds_its_words():
    words = sorted(f"{a}{b}".encode() for a in ("walk", "talk", "jump") for b in ("", "s", "ed", "ing"))
    lexicon = bpe.Lexicon(bpe.build_automaton([(w, [n, n + 1]) for n, w in enumerate(words)]))
    assert lexicon.find(words).tolist() == list(range(12))
    assert lexicon.find([b"wal", b"walkss", b"", b"x", b"y" * 100]).tolist() == [-1] * 5
    assert len(lexicon.final) < sum(map(len, words)) // 3
    assert bpe.Lexicon(bpe.build_automaton([])).find([b"a"]).tolist() == [-1]


def test_bpe_query(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in bpe.result(frame(spark, TEXTS), path).collect():
        ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    assert bpe.result(frame(spark, []), path).count() == 0


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def base_brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) if n % 2 == 0 else sum(divmod(2 * int(c), 10)) for n, c in enumerate(reversed(digits))]
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(doubled) % 10 == 0):
                continue
            out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_pii_against_brute_force(spark):
    signs = list("ab19.@+- ()%é\U0001f600") + ["a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+49 (0) 12345678", "..", "--", "a@b.c%d@e.f", "@x.y", "5500005555555559", "+1 202-555-0100"]
    texts = ["".join(R.choice(signs) for _ in range(R.randrange(25))) for _ in range(800)] + [None, "", "1 " * 9000, "1" * 20000, "a." * 9000 + "@b.c", "x@" + "a." * 9000 + "c", "1." * 3000, "@" * 900]
    for r in pii.result(frame(spark, texts)).collect():
        want = base_brute(texts[r.doc_id])
        assert [x for x in r.spans.split(",") if x and not x.startswith("term")] == want
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r.n_email == sum(x.startswith("email") for x in want)


def test_pii_terms_that_reveal_an_address(spark):
    filler = ["the weather was fine and nothing else happened in town that day number %d" % i for i in range(60)]
    near = [f"note {i * 37} from quasimodo please reply to bell@tower.org before {i * 91} ends" for i in range(6)]
    alone = ["yesterday Quasimodo rang again"]
    docs = frame(spark, filler + near + alone)
    rows = {r.doc_id: r.spans for r in pii.result(docs).collect()}
    assert rows[66] == "term:10:19" and all("term" in rows[60 + i] for i in range(6)) and not any(rows[i] for i in range(60))
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[66] == "yesterday [TERM] rang again" and clean[3] == filler[3] and "[EMAIL]" in clean[61] and "tower" not in clean[61]
    copies = frame(spark, [near[0]] * 8 + filler)
    assert not any("term" in r.spans for r in pii.result(copies).collect())  # copies are one context
    assert pii.result(frame(spark, [])).count() == 0


def test_pii_terms_whose_lower_case_depends_on_what_follows(spark):
    filler = ["the weather was fine and nothing else happened in town that day number %d" % i for i in range(60)]
    near = [f"note {i * 37} from ΛΟΓΟΣ{'. :'[i % 3]}please reply to bell@tower.org before {i * 91} ends" for i in range(6)]
    docs = ["yesterday ΛΟΓΟΣ rang", "yesterday ΛΟΓΟΣ.alpha rang", "yesterday ΛΟΓΟΣ'Σ rang", "yesterday λογος"]
    rows = {r.doc_id: r.spans for r in pii.result(frame(spark, filler + near + docs)).collect()}
    assert [rows[66 + i] for i in range(4)] == ["term:10:15"] * 4 and all("term" in rows[60 + i] for i in range(6))


def test_pii_of_null_and_repeated_ids(spark):
    texts = ["mail a@b.org", "nothing", "mail a@b.org", None, "ring +49 1234 56789"]
    got = sorted((str(r.doc_id), r.spans) for r in pii.result(frame(spark, texts, [None, None, 3, 3, 3])).collect())
    assert got == sorted([("None", "email:5:12"), ("None", ""), ("3", "email:5:12"), ("3", ""), ("3", "phone:5:19")])


def test_pii_terms_count_contexts_not_copies(spark):
    filler = ["the weather was fine and nothing else happened in town that day number %d" % i for i in range(60)]
    near = [f"note {i * 37} from quasimodo please reply to bell@tower.org before {i * 91} ends" for i in range(6)]
    rows = {r.doc_id: r.spans for r in pii.result(frame(spark, filler + near + [near[0]] * 7)).collect()}
    assert all("term" in rows[60 + i] for i in range(13)) and not any(rows[i] for i in range(60))
    # A passage away from the entity, in documents that differ elsewhere, is one context as well.
    passage = "one two three four five six seven eight quasimodo nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = {r.doc_id: r.spans for r in pii.result(frame(spark, filler + near + [f"start{i} {passage} stop{i}" for i in range(20)])).collect()}
    assert all("term" in rows[66 + i] for i in range(20))
    # Different contexts away from the entity still count.
    rows = {r.doc_id: r.spans for r in pii.result(frame(spark, filler + near + [f"w{i} quasimodo rang v{i}" for i in range(20)])).collect()}
    assert not any("term" in rows[66 + i] for i in range(20))


def test_pii_bits_decide_where_the_entity_is_everywhere(spark):
    near = [f"note {i * 37} from quasimodo please reply to bell@tower.org before {i * 91} ends" for i in range(6)]
    # With little other text the address is no news near the name, though the name hardly stands elsewhere.
    filler = ["nothing else happened in town that day number %d" % i for i in range(12)]
    rows = [r.spans for r in pii.result(frame(spark, near + filler)).collect()]
    assert not any("term" in x for x in rows)
    rows = {r.doc_id: r.spans for r in pii.result(frame(spark, near + filler + [f"{x} again{i}" for i, x in enumerate(filler * 9)])).collect()}
    assert all("term" in rows[i] for i in range(6))


def test_pii_terms_give_way_to_base_spans(spark):
    near = [f"note {i * 37} from quasimodo please reply to bell@tower.org before {i * 91} ends" for i in range(6)]
    filler = ["the weather was fine and nothing else happened in town that day number %d" % i for i in range(60)]
    odd = ["ask quasimodo@x.org or quasimodo.quasimodo@y.org, Quasimodo", "quasimodo 1.2.3.4quasimodo"]
    docs = frame(spark, near + filler + odd, [*range(66), None, 67])
    rows = {r.doc_id: r.spans for r in pii.result(docs).collect()}
    assert rows[None] == "email:4:19,email:23:48,term:50:59" and rows[67] == "term:0:9,ip:10:17"
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[None] == "ask [EMAIL] or [EMAIL], [TERM]" and clean[67] == "[TERM] [IP]quasimodo"


def test_pii_time_stays_near_the_length(spark):
    import time

    near = [f"note {i * 37} from quasimodo please reply to bell@tower.org before {i * 91} ends" for i in range(6)]
    filler = ["the weather was fine and nothing else happened in town that day number %d" % i for i in range(60)]
    spent = []
    for n in (2_000, 20_000, 40_000):  # the first run compiles
        docs = frame(spark, near + filler + ["one two three four five six seven eight quasimodo " * (n // 9)])
        began = time.time()
        found = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
        spent.append(time.time() - began)
        assert found[66] == "one two three four five six seven eight [TERM] " * (n // 9)
    assert spent[2] < 3 * spent[1]


def test_word_tokenizer_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = FUZZ + [t or "" for t in TEXTS]
    for t, ids in zip(texts, tokenfile.WordTokenizer(path).column(pa.array(texts))):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def test_word_tokenizer_equals_the_library_on_every_code_point():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), tokenfile.WordTokenizer(path)
    strange = pretoken.unassigned()
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = []
    for group in ([i for i in points if not strange[i]], [i for i in points if strange[i]]):  # apart, as unknown ones go whole
        for a in range(0, len(group), 40):
            texts.append(" ".join("ab{0}cd 1{0}? .{0}?".format(chr(i)) for i in group[a : a + 40]))
    want = library.encode_batch_fast(texts, add_special_tokens=False)
    assert not [t[:20] for t, x, ids in zip(texts, want, own.column(pa.array(texts))) if ids.tolist() != x.ids]


def test_token_files_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, start = Tokenizer.from_file(path), 0
    rows = sorted(tokenfile.result(frame(spark, TEXTS[::-1], list(range(len(TEXTS)))[::-1]), path).collect())
    assert [r.doc_id for r in rows] == list(range(len(TEXTS)))
    for r in rows:
        ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfile.result(frame(spark, []), path).count() == 0
    assert len(tokenfile.result(frame(spark, ["a", "b", "c"], [1, 1, None]), path).collect()) == 3
    assert (tokenfile.id_type(50_000), tokenfile.id_type(70_000)) == ("<u2", "<u4")


def test_kneser_ney_against_dictionaries(spark):
    docs = frame(spark, TEXTS)
    words = [re.findall(r"[^\x20\x09-\x0D]+", lowered(t)) for t in TEXTS]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(TEXTS))]
    one, two = collections.Counter(), collections.Counter()
    for w, h in zip(words, held):
        if not h:
            one.update([*w, "</s>"])
            two.update(zip(["<s>", *w], [*w, "</s>"]))
    n, v = sum(one.values()), len(one)
    before = collections.Counter(b for _, b in two)
    d, d1 = (ngram.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]) for c in (two, before))
    total, follow = collections.Counter(), collections.defaultdict(lambda: [0] * 4)
    for (a, _), c in two.items():
        total[a] += c
        follow[a][min(c, 3)] += 1
    left = sum(d1[min(x, 3)] for x in before.values()) / len(two)

    def p(a, b):
        low = max(before[b] - d1[min(before[b], 3)], 0) / len(two) + left / (v + 1)
        if not total[a]:
            return low
        return max(two[a, b] - d[min(two[a, b], 3)], 0) / total[a] + sum(d[i] * follow[a][i] for i in (1, 2, 3)) / total[a] * low

    assert sum(p("alpha", b) for b in one) + p("alpha", "unseen") == pytest.approx(1)
    for r in ngram.result(docs).collect():
        w = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(w) + 1, n)
        assert r.n_known == sum(x in one for x in [*w, "</s>"])
        assert r.base_score == pytest.approx(sum(math.log10((one[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, "</s>"]))
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], [*w, "</s>"])))


def test_counts_above_a_byte_and_packing(spark):
    values = np.array([0, 3, 2**63, 5], np.uint64)
    assert (ngram.unpack(ngram.pack(values)) == values).all()
    assert (ngram.unpack_sorted(ngram.pack_sorted(np.sort(values))) == np.sort(values)).all()
    model = ngram.train(frame(spark, ["a b " * 400]))
    key = np.sort(ngram.pair_hash(*(np.array([x], np.uint64) for x in (ngram.token_stream(np.frombuffer(b"a b", np.uint8), np.array([0, 3]))[0][:2]))))
    assert model.pair_counts(key).tolist() == [400] and model.tokens == 801
    assert ngram.result(frame(spark, [])).count() == 0


def simhash_brute(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    got = {r.doc_id: r for r in simhash.result(frame(spark, TEXTS)).collect()}
    prints = [simhash_brute(t) for t in TEXTS]
    label = list(range(len(TEXTS)))
    for _ in TEXTS:
        for a in range(len(TEXTS)):
            label[a] = min(label[b] for b in range(len(TEXTS)) if (prints[a] ^ prints[b]).bit_count() <= 2)
    for i, f in enumerate(prints):
        assert got[i].fingerprint == f"{f:016x}" and got[i].component_id == label[i]
    assert simhash.result(frame(spark, [])).count() == 0
    assert len(simhash.result(frame(spark, ["a", "a", "a"], [1, 1, None])).collect()) == 3


@pytest.mark.parametrize("cap", [1, 16])
def test_links_connect_all_near_values(spark, cap):
    rng = np.random.default_rng(cap)
    values = {int(x) for x in rng.integers(0, 1 << 63, 20)}
    for x in list(values)[:6]:
        for _ in range(20):
            x ^= 1 << int(rng.integers(64))
            values.add(x)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), cap=cap).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in found)
    label = {v: v for v in values}

    def join(pairs):
        own, changed = dict(label), True
        while changed:
            changed = False
            for a, b in pairs:
                low = min(own[a], own[b])
                changed |= own[a] != low or own[b] != low
                own[a] = own[b] = low
        return own

    true = [(a, b) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert join([(r.a, r.b) for r in found]) == join(true)


@pytest.mark.parametrize("piece", [1, 7, 40, 1 << 19])
def test_long_texts_in_pieces(monkeypatch, piece):
    """Shingles, fingerprints and sets of a text don't depend on how it is cut."""
    monkeypatch.setattr(simhash, "PIECE", piece)
    texts = [t for t in TEXTS if t is not None] + ["a b", "\x20" * 50, "x" * 90 + " y z " + "w" * 90, " lead and trail  "]
    for k in (1, 3, 5):
        for t in texts:
            raw = np.frombuffer(t.encode(), np.uint8)
            tidy, s, e, _ = simhash.shingle_spans(textops.lower(raw), np.array([0, len(raw)]), k)
            want = [tidy[i:j] for i, j in zip(s.tolist(), e.tolist())]
            assert [x for part in simhash.long_shingles(raw, k) for x in part] == want
            assert simhash.long_fingerprint(raw, k) == (simhash.fingerprint_column(pa.array([t]), k).view(np.uint64)[0] if want else 0)
            h, low = nearcopies._long_set(raw, k)
            _, _, _, sets = nearcopies.sketch(pa.array([t]), k)
            assert h.view(np.int64).tolist() == sorted(sets[0].view(np.uint64).tolist()) or (h == np.sort(sets[0].view(np.uint64))).all()
            assert len(low) == bool(want)


def test_memory_of_a_very_long_text():
    """A text of some megabytes is hashed in memory near its own size."""
    import tracemalloc

    column = pa.array(["".join(f"word{i % 977} " for i in range(900_000))])
    for hashed in (lambda: simhash.fingerprint_column(column, 3), lambda: nearcopies.sketch(column, 5)):
        tracemalloc.start()
        hashed()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 12 * column.nbytes


def test_popcount_distance_is_a_lower_bound(spark):
    rows = [(R.randrange(1 << 62), R.randrange(1 << 62)) for _ in range(50)]
    df = spark.createDataFrame(rows, "a long, b long")
    from pyspark.sql import functions as F

    pairs = df.select("a", "b", simhash.unary_popcounts(F.col("a")).alias("x"), simhash.unary_popcounts(F.col("b")).alias("y")).collect()
    for r in pairs:
        segments = [((r.a >> i) & 3).bit_count() - ((r.b >> i) & 3).bit_count() for i in range(0, 64, 2)]
        assert (r.x ^ r.y).bit_count() == sum(map(abs, segments)) <= (r.a ^ r.b).bit_count()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, graph.components(edges).collect()))
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}


def test_components_read_the_edges_within_a_group_once(spark, monkeypatch):
    """A crowded group beside a chain that takes several rounds; then links are added to what is known."""
    r, rows = random.Random(5), []

    def counted(df, label):
        out = common.written(df, label)
        rows.append(out.count()) if label == "edges" else None
        return out

    monkeypatch.setattr(graph, "written", counted)
    crowd = {(min(p), max(p)) for p in (r.sample(range(1000, 1100), 2) for _ in range(2000))}
    chain = [(i, i + 1) for i in range(40)]
    labels = graph.components(spark.createDataFrame([*crowd, *chain, (7, 7)], "a long, b long"))
    assert dict(map(tuple, labels.collect())) == {i: 0 for i in range(41)} | {i: 1000 for i in range(1000, 1100)}
    assert rows[0] == 2 * (len(crowd) + len(chain)) and len(rows) == 2 and rows[1] < 200
    rows.clear()
    more = spark.createDataFrame([(1001, 900), (1050, 900), (1002, 1003), (2000, 2001), (2001, 2002)], "a long, b long")
    got = dict(map(tuple, graph.extended(labels, more).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 900 for i in [900, *range(1000, 1100)]} | {i: 2000 for i in range(2000, 2003)}
    assert rows[0] == 2 * 3


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(20 + 15 * seed)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    half = len(edges) // 2
    first = graph.components(spark.createDataFrame(edges[:half], "a long, b long"))
    assert dict(map(tuple, graph.extended(first, spark.createDataFrame(edges[half:], "a long, b long")).collect())) == label
    assert dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect())) == label


def shingles_brute(text, k=5):
    words = lowered(text).split()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near_groups_brute(texts, similarity=0.8):
    """``(labels, pairs)`` by all pairs."""
    sets, label = [shingles_brute(t) for t in texts], list(range(len(texts)))
    pairs = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and len(a & b) / len(a | b) >= similarity):
                pairs.append((i, j))
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label, pairs


def edited(words, edits, r):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = "w%d" % r.randrange(10**6)
    return words


@pytest.mark.parametrize("cap", [1, 8])
def test_near_copies_against_brute_force(spark, cap):
    r = random.Random(11)
    base = [["v%d" % r.randrange(5000) for _ in range(r.choice([60, 150, 400]))] for _ in range(30)]
    texts = [" ".join(edited(w, e, r)) for w in base for e in range(0, max(2, len(w) // 40 + 1))]
    crowd = edited(base[0], 0, r)
    for _ in range(25):  # a chain whose ends are no near copies, in crowded cells
        texts.append(" ".join(crowd))
        crowd = edited(crowd, 1, r)
    texts += [None, "", " ", "one two", "One  two", "one three", texts[0]]
    want, pairs = near_groups_brute(texts)
    sets = [shingles_brute(t) for t in texts]
    assert sum(0.8 <= len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.95 for i, j in pairs if sets[i]) > 20
    got = {x.doc_id: x.label for x in nearcopies.near_copies(frame(spark, texts), cap=cap).collect()}
    assert len(got) == len(texts)
    assert [want.index(x) for x in want] == [[got[i] for i in range(len(texts))].index(got[j]) for j in range(len(texts))]
    assert nearcopies.near_copies(frame(spark, [])).count() == 0


def test_pipeline_drops_near_copies_of_similarity_above_four_fifths(spark):
    import corpus_pipeline

    r = random.Random(3)
    words = ["v%d" % i for i in range(200)]
    texts = [" ".join(words), " ".join(words[:60] + ["x"] + words[61:140] + ["y"] + words[141:]), " ".join(edited(words, 40, r))]
    a, b, c = map(shingles_brute, texts)
    assert 0.8 <= len(a & b) / len(a | b) < 0.95 and len(a & c) / len(a | c) < 0.5
    assert {x.doc_id for x in corpus_pipeline.one_of_each_group(spark, frame(spark, texts), "").collect()} == {0, 2}


def test_gradients_through_time():
    net = langid.Network(["a", "b"])
    for layer in (net.left, net.right):
        for name in langid.Layer.NAMES:
            setattr(layer, name, getattr(layer, name).astype(float))
    net.w_left, net.w_right, net.b = (x.astype(float) for x in (net.w_left, net.w_right, net.b))
    rng = np.random.default_rng(0)
    window, label = rng.integers(0, 4, (3, 6)).astype(np.uint8), np.array([0, 1, 1])
    _, grads = net.gradients(window, label)
    for p, g in zip(net.parameters(), grads):
        at = tuple(rng.integers(0, min(n, 4)) for n in p.shape)
        was, sides = p[at], []
        for step in (1e-5, -1e-5):
            p[at] = was + step
            sides.append(net.gradients(window, label)[0])
        p[at] = was
        assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(g[at], abs=1e-6)


def test_probabilities_are_pooled_over_all_positions():
    """The mean of each byte's distribution, one byte at a time, windows of 64 bytes apart."""
    network = langid.Network(["de", "en", "fr"], seed=9)
    texts = ["short", "é" * 50 + " mixed text", "".join(R.choice("abc dé") for _ in range(300)), "123 456", None, ""]
    best, score = network.documents(pa.array(texts))
    for n, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        if not any(c.isalpha() for c in t or ""):
            assert (best[n], score[n]) == (-1, 0.0)
            continue
        total = np.zeros(3)
        for a in range(0, len(raw), langid.WINDOW):
            window = raw[a : a + langid.WINDOW]
            states = []
            for layer, order in ((network.left, window), (network.right, window[::-1])):
                h, own = np.zeros((1, langid.HIDDEN), np.float32), []
                for byte in order:
                    h, _ = layer.step(np.array([byte]), h)
                    own.append(h)
                states.append(own)
            for i in range(len(window)):
                z = (states[0][i] @ network.w_left + states[1][len(window) - 1 - i] @ network.w_right + network.b)[0]
                total += np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        mean = total / len(raw)
        assert best[n] == mean.argmax() and abs(score[n] - mean.max()) < 1e-5


def test_languages_of_any_number_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ALL", 6)
    rows = [(None if i % 5 == 0 else i % 7, f"text {chr(97 + i % 26) * 9} {i}", f"l{i % 12:02}", i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    network = langid.train(docs)
    assert network.languages == sorted({f"l{i % 12:02}" for i in range(60) if zlib.crc32(str(rows[i][0] if rows[i][0] is not None else "").encode()) % 5})
    got = langid.predict(docs, network).collect()
    assert len(got) == 60 and all(r.lang_pred in network.languages and 0 <= r.score <= 1 for r in got)


def test_language_on_held_out_rows(spark):
    kinds = {"aa": ["la", "ra", "ta"], "bb": ["ski", "pli", "tri"], "cc": ["og", "ug", "ng"]}
    rows = [(i, " ".join(R.choice(kinds[k]) + R.choice(kinds[k]) for _ in range(20)), k) for i, k in enumerate(list(kinds) * 40)]
    rows += [(200, None, "aa"), (201, "", None), (202, "123 !!", "bb"), (203, "lara " * 4000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.result(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (200, 201, 202)) and got[203].lang_pred == "aa"
    held = [(got[i].lang_pred, k) for i, _, k in rows[:120] if got[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.9 and all(0 <= r.score <= 1 for r in got.values())
    assert langid.result(docs.limit(0)).count() == 0


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    with pytest.raises(ValueError):
        common.local_path("hdfs://a/b")


def test_registry_lists_all():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14))
    assert pretoken.classes()[ord("a")] == pretoken.LETTER


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, labels = quality_data(spark)
    item = "one two three four five six seven eight nine ten eleven"
    extra = frame(spark, [f"Beta gamma {item} eta", "alpha zeta eta gamma write to me@home.org please", TEXTS[0]], [900, 901, 902])
    docs.unionByName(extra).unionByName(frame(spark, [TEXTS[0]], [903])).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    held = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, held, str(tmp_path))
        assert after.columns == held.columns
        after.write.parquet(str(tmp_path / name))
        held, before = spark.read.parquet(str(tmp_path / name)), held
        if name == "pii":
            assert "[EMAIL]" in held.where("doc_id = 901").first().text and held.count() == before.count()
        if name == "near_duplicates":
            assert held.where("doc_id IN (902, 903)").count() == 1
    ids = {r.doc_id for r in held.select("doc_id").collect()}
    assert 900 not in ids and 901 in ids and not ids & set(range(125, 180))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids


def test_pipeline_links_texts_by_their_fingerprints(spark):
    """Two texts of one op9 component with few shingles in common, and a near copy of one of them, are one group."""
    import corpus_pipeline
    from weftline.llm import simhash

    chorus = "alpha beta gamma delta epsilon zeta eta " * 60
    tail = lambda sign: " ".join(f"{sign}{n}" for n in range(60))
    texts = [chorus + tail("a"), chorus + tail("b"), chorus + tail("b") + " end", tail("c"), None, ""]
    docs = frame(spark, texts)
    prints = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert prints[0] == prints[1] == 0 and prints[3] == 3
    assert {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()} == {0, 3, 4}
