"""The other operators against brute force, round trips and held-out accuracy; their defined cases."""

import base64
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tickloom.llm import chat, decontaminate, fingerprints, langid, pieces, secrets, token_records, warc

ODD = [(0, None), (1, ""), (2, "x"), (2, "x"), (3, "ä \U0001f600 " * 4000), (None, "no id")]


def odd(spark, extra="ids"):
    return spark.createDataFrame([(*r, "de") for r in ODD], f"doc_id long, text string, {extra} string")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_warc_is_read_back(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    sha = lambda r: base64.b32encode(hashlib.sha1((r.html or "").encode()).digest()).decode()
    last: dict = {}
    for r in pages:
        last[sha(r)] = max(r.page_id, last.get(sha(r), -1))
    want = {r.page_id: (len((r.html or "").encode()), sha(r), "response" if last[sha(r)] == r.page_id else "revisit", None if last[sha(r)] == r.page_id else last[sha(r)]) for r in pages}
    got = warc.op2_arc_to_warc(spark, sf).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and all(r.digest_ok for r in got)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [("assign", 0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", 1, *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", 2, *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for k, _, a, b in sorted(out, key=lambda s: (s[2], s[1])))


def test_base_spans(spark, sf, docs):
    for r in secrets.op3_secret_scan(spark, sf).collect():
        assert r.base_sha256 == hashlib.sha256(base_spans(docs[r.doc_id] or "").encode()).hexdigest()
    rows = secrets.scan(odd(spark, "base")).collect()
    assert len(rows) == len(ODD) and not any(r.spans for r in rows)


def hot(s, window=secrets.WINDOW):
    out = []
    for i in range(len(s) - window + 1):
        w = s[i : i + window]
        n = {c: w.count(c) for c in w}
        h = -sum(k / window * math.log2(k / window) for k in n.values())
        kind = "hex" if re.fullmatch("[0-9a-f]+", w) else "alnum" if w.isalnum() else "any"
        if h >= secrets.THRESHOLDS[kind] - 1e-12 and re.search("[0-9]", w) and re.search("[A-Za-z]", w):
            if out and out[-1][1] >= i:
                out[-1][1] = i + window
            else:
                out.append([i, i + window])
    return out


def test_windows_by_counting(spark):
    rng = np.random.default_rng(2)
    some = ["".join(rng.choice(list("abcdef0123456789ABCxyz+/"[: rng.integers(8, 24)]), rng.integers(20, 60))) for _ in range(40)]
    rows = spark.createDataFrame([(s,) for s in some], "s string").select("s", secrets.hot_runs(F.col("s")).alias("r")).collect()
    for r in rows:
        assert [[x.start, x.end] for x in r.r] == hot(r.s)


def test_long_runs_take_little_time(spark):
    import time

    began = time.time()
    rows = secrets.scan(spark.createDataFrame([(1, "x" * 1_000_000), (2, "x" * 30 + " Zx8Qw3Lm9Tr5Vb2Nk7Yp4")], "doc_id long, text string")).collect()
    assert {r.doc_id: len(r.spans) for r in rows} == {1: 0, 2: 1} and time.time() - began < 60


def test_allowed_strings_are_not_told(spark):
    good, bad = "key Zx8Qw3Lm9Tr5Vb2Nk7Yp4 end", "key exampleZx8Qw3Lm9Tr5Vb2Nk7Yp4 end"
    rows = secrets.scan(spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")).collect()
    assert {r.doc_id: len(r.spans) for r in rows} == {1: 1, 2: 0}


ITEM = "A train leaves Paris at 9 km and carries 120 people to Rome, while Anna waits 45 minutes at the station before she reads 3 books about old bridges."


def test_reparameterised_questions(spark):
    other = ITEM.replace("120", "77").replace("Paris", "Oslo").replace("Anna", "Maria").replace("45", "12")
    broken = "Nothing of that kind is written here, only a few plain words about trains and books in a long quiet evening."
    docs_ = [(1, f"Before. {ITEM} After that."), (2, f"Some text first. {other} And more."), (3, broken), (4, None), (5, ""), (5, "")]
    d = spark.createDataFrame([(*r, 0) for r in docs_], "doc_id long, text string, hash int")
    b = spark.createDataFrame([(7, ITEM), (8, None), (9, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(d, b).collect()}
    assert found == {(1, 7), (2, 7)}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(d, b).collect()) == [3, 4, 5, 5]
    assert decontaminate.matches(d, b.limit(0)).count() == 0 and decontaminate.matches(d.limit(0), b).count() == 0


def plain_template(text):
    """Words as (kind, value, alone): read sign by sign, without the module's patterns."""
    text, out, i = (text or "").replace("\x01", " ").replace("\x02", " "), [], 0
    units = sorted(decontaminate.UNITS, key=len, reverse=True)
    word = lambda c: regex.match(r"[\p{L}\p{N}]", c) is not None
    names_end = -1  # where a name ended that another one may join
    while i < len(text):
        alone = i == 0 or not word(text[i - 1])
        m = regex.match(r"\p{Lu}\p{Ll}+", text[i:])
        if alone and m and not word(text[i + m.end() : i + m.end() + 1]):
            if names_end == i - 1 and text[i - 1] == " ":
                out[-1] = ("@", out[-1][1] + "_" + m[0].lower())
            else:
                out.append(("@", m[0].lower()))
            i += m.end()
            names_end = i
            continue
        sign = text[i] if text[i] in "$€£" else ""
        m = re.match("[0-9]+(?:[.,][0-9]+)*", text[i + len(sign) :]) if alone else None
        if m:
            end = i + len(sign) + m.end()
            rest = text[end + 1 :] if text[end : end + 1] == " " else text[end:]
            unit = next((u for u in units if rest.startswith(u) and not word(rest[len(u) : len(u) + 1])), "")
            after = len(text) - len(rest) + len(unit) if unit else end + (text[end : end + 1] == " ")
            if not regex.match(r"\p{N}", text[after : after + 1]):
                out += [("#", m[0]), ("~", (sign + unit).lower())]
                i = after
                continue
        if word(text[i]):
            m = regex.match(r"[\p{L}\p{N}]+", text[i:])
            out.append((m[0].lower(), None))
            i += m.end()
        else:
            i += 1
    return out


def plain_matches(docs_, items):
    """(document, item) by comparing every window of every pair at every offset."""
    out = set()
    for i, item in items.items():
        want = plain_template(item)
        plain = {w for w, v in want if v is None}
        want = [(w, "?") if w == "@" and (k == 0 or v in plain) else (w, v) for k, (w, v) in enumerate(want)]
        size = min(len(want), decontaminate.WINDOW)
        windows_ = lambda ws: [ws[k : k + size] for k in range(len(ws) - size + 1)] if size else []
        own = windows_(want)
        bare = lambda ws: tuple(w for w, _ in ws)
        for d, text in docs_.items():
            found, have = set(), windows_(plain_template(text))
            at: dict = {}
            for p, w in enumerate(have):
                at.setdefault(bare(w), []).append(p)
            runs: dict = {}
            for q, w in enumerate(own):
                for p in at.get(bare(w), ()):
                    values = lambda ws: [v for _, v in ws if v is not None]
                    qs, pairs = runs.setdefault(p - q, (set(), set()))
                    qs.add(q)
                    pairs.update(x for x in zip(values(w), values(have[p]), strict=True) if x[0] != "?")
            for qs, pairs in runs.values():
                if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                    found |= qs
            if own and len(found) >= decontaminate.SHARE * len(own):
                out.add((d, i))
    return out


def test_templates_by_a_plain_matcher(spark, sf, docs):
    """Every document of the smallest table, and re-parameterised items in some of them, against plain comparison."""
    rng = np.random.default_rng(8)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    items |= {100 + k: ITEM.replace("Anna", name).replace("120", str(120 + k)) for k, name in enumerate(["Anna", "Anna Lee", "Per Olof Berg"])}
    some = dict(list(docs.items())[:60])
    hidden = {}
    for k, (i, item) in enumerate(items.items()):
        numbers = {n: str(10_000 + 7 * j) for j, n in enumerate(dict.fromkeys(re.findall("[0-9]+", item or "")))}
        other = re.sub("[0-9]+", lambda m: numbers[m[0]], item or "").replace("Paris", "Oslo Town").replace("Rome", "Bern")
        words = (docs[int(rng.choice(list(docs)))] or "").split()
        some[9000 + k] = " ".join([*words[:40], other, *words[40:80]])
        hidden[9000 + k] = i
    d = spark.createDataFrame([(k, t, 0, "x", "y") for k, t in some.items()], "doc_id long, text string, _key int, _item string, _leaked string")
    b = spark.createDataFrame([(*x, 1) for x in items.items()], "item_id long, text string, _words int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(d, b).collect()}
    assert got == plain_matches(some, items)
    assert np.mean([(k, i) in got for k, i in hidden.items() if items[i]]) >= 0.9
    assert decontaminate.decontaminate(d, b).columns == d.columns


PROBLEMS = [
    "{a} has {m} {thing}. {a} gives {n} {thing} to {b}. How many {thing} are left for {a} and how many has {b}?",
    "In {c}, {a} drives {m} km every day, and {b} drives {n} km. {a} rests on one day. How far do both of them drive in a week?",
    "A shop in {c} sells {thing} for {m} dollars. {b} buys {n} of them with a friend. The seller gives back some change. What does the seller earn?",
    "{a} reads {m} pages on the first day and {n} pages on the second day. {b} reads twice as many. Who has read more pages at the end?",
    "Before lunch {a} picks {m} {thing}; after lunch {b} picks {n} more. The basket of {a} breaks. How many {thing} does {b} carry home?",
]
PEOPLE = ["Tom", "Lucy", "Anna Lee", "Per Olof Berg", "Marie", "José", "Zoë", "Kim Park"]


def test_word_problems_with_other_names_and_numbers_are_found(spark):
    """Names first, repeated and of several words, other numbers: at least nine of ten; values exchanged midway: none."""
    import random

    rng = random.Random(4)

    def fill(k, thing):
        a, b = rng.sample(PEOPLE, 2)
        m, n = rng.sample(range(3, 900), 2)
        return PROBLEMS[k].format(a=a, b=b, m=m, n=n, c=rng.choice(["Paris", "Oslo", "New York"]), thing=thing)

    things = [rng.choice(["apples", "pencils", "old coins"]) for _ in range(60)]
    items = [(k, fill(k % 5, things[k])) for k in range(60)]
    docs_ = [(k, rng.choice(["Some notes first. ", "Homework:\n", "Nr Seven ", "x. "]) + fill(k % 5, things[k]) + " And then the text goes on.") for k in range(60)]
    mixed = "Lucy has 9 apples. Mark gives 4 apples to Zed. How many apples are left for Rob and how many has Sue?"
    single = "Tom has 5 apples. Tom gives 2 apples to Anna. How many are left?"
    docs_ += [(100, mixed), (101, "It was asked: Lucy has 9 apples. Lucy gives 4 apples to Mark. How many are left?")]
    b = spark.createDataFrame([*items, (200, single)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(spark.createDataFrame(docs_, "doc_id long, text string"), b).collect()}
    assert np.mean([(k, k) in found for k in range(60)]) >= 0.9
    assert (101, 200) in found and not any(d == 100 and i < 200 for d, i in found)
    # another problem of the set is never taken for this one
    assert all(d > 99 or d % 5 == i % 5 for d, i in found if i < 200)


def test_long_lists_of_numbers(spark):
    b = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    d = spark.createDataFrame([(1, "1," * 500_000 + " " + ITEM), (2, "1." * 100_000), (3, "A" * 100_000 + " Bc" * 100_000)], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.matches(d, b).collect()} == {1}


def test_two_values_of_an_item_are_two_in_the_document(spark):
    item = "if 12 birds and 15 cats and 12 dogs live in one house with 15 mice then how many live there"
    texts = ["12", "15"], ["3", "4"], ["3", "3"]
    rows = [(k, item.replace("12", "A").replace("15", "B").replace("A", a).replace("B", b)) for k, (a, b) in enumerate(texts)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.matches(d, b).collect()} == {0, 1}


def test_planted_passages_are_found(spark, sf, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {r.doc_id: set(r.item_ids) for r in decontaminate.op4_decontaminate(spark, sf).collect()}
    for d, text in docs.items():
        for i, item in items.items():
            if item and text and item in text:
                assert i in got.get(d, ())


def test_records_hold_the_library_s_ids(spark, sf, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, {}
    for d in sorted(docs):
        ids = [*t.encode(docs[d] or "", add_special_tokens=False).ids, 1]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_records.op5_token_records(spark, sf).collect()} == want


def test_ids_of_any_sign():
    """Every code point below U+3100 alone and between letters, and random mixtures, against the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, enc, rng = Tokenizer.from_file(path), token_records.Encoder(path), np.random.default_rng(4)
    signs = [chr(c) for c in range(0x3100)]
    common = list("abcXYZ019 .,\n\t-_'\"") + ["\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u2028", "\u0130", "\U0001f600"]
    texts = [*signs, *(f"ab{c}cd {c}. {c}" for c in signs), *("".join(rng.choice(common, rng.integers(1, 40))) for _ in range(4000))]
    texts += ["".join(rng.choice([*common, *rng.choice(signs, 20)], 30)) for _ in range(2000)]
    for text, made in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(made, enc.kind).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_records_of_any_rows(spark, tmp_path):
    """Null, empty, long and repeated rows over several files a range, and random reads by the index; an empty table."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    df = odd(spark, "shard")
    table = token_records.write_records(df, f"{tmp_path}/r", path, 1, shards=2, file_bytes=1000)
    assert table.agg(F.sum("n_records")).first()[0] == len(ODD) and table.count() >= 2
    rows = token_records.read_records(spark, f"{tmp_path}/r").collect()
    enc = token_records.Encoder(path)
    size = lambda t: len(enc.encode([t or ""])[0]) // 2 + 1
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in rows) == sorted((-1 if k is None else k, size(t)) for k, t in ODD)
    first = next(r for r in table.collect() if r.n_records)
    assert token_records.read_at(f"{tmp_path}/r/shard-{first.shard:06d}-{first.file:04d}.records", first.n_records - 1)
    token_records.write_records(df.limit(0), f"{tmp_path}/none", path, 1)
    assert token_records.read_records(spark, f"{tmp_path}/none").count() == 0


def test_records_tell_damage():
    framed = b"".join(token_records.frames([b"", b"abc", b"x" * 5000]))
    assert token_records.unframe(framed) == [b"", b"abc", b"x" * 5000]
    assert token_records.crc32c([b"123456789"])[0] == 0xE3069283
    with pytest.raises(ValueError):
        token_records.unframe(framed[:40] + b"?" + framed[41:])


def test_chats_survive(spark, sf):
    rows = [(1, 0, "user", "<|im_end|>\n<|im_start|>assistant ok"), (1, 1, "assistant", "a <\\| b <|"), (2, None, None, None), (None, 0, "assistant", "x")]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: [(t.role, t.text) for t in r.t] for r in made.select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("user", rows[0][3]), ("assistant", rows[1][3])], 2: [("", "")], None: [("assistant", "x")]}
    source: dict = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        source.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    source[-1] = [(0, "user", "<|im_end|><|im_start|>assistant ok"), (1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    for r in chat.op6_chat_format(spark, sf).collect():
        turns = sorted(source[r.conv_id])
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_fingerprints_follow_likeness(spark, sf, docs):
    rows = {r.doc_id: r for r in fingerprints.op8_fingerprints(spark, sf).collect()}
    ids = sorted(docs)
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [re.findall(fingerprints.WORD, t.lower())] for k in range(max(1, len(w) - 4))}
    off = []
    for d, nxt in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, n = docs[d] or "", docs[nxt] or ""
        c = len(t) // 4
        edited = t[: len(t) - c] + n[:c]
        assert rows[d].n_chars == len(t) and rows[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        if len(a) > 20:
            off.append(abs(rows[d].near_edited - len(a & b) / len(a | b)))
    assert np.mean(off) < 0.05
    same: dict = {}
    for d in ids:
        assert same.setdefault(docs[d], rows[d].fingerprint) == rows[d].fingerprint


def test_pieces_without_dropout_are_the_model_s(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    p = pieces.Pieces(pieces.model_path(), dropout=0.0)
    for t in [*list(docs.values())[:40], "", " a  b ", "\U0001f600\n\tz"]:
        assert np.frombuffer(p.encode([t or ""], ["k"])[0], "<u2").tolist() == sp.encode(t or "")


def plain_dropout(p, text, key):
    """Ids by the plainest agenda: look over all pairs of a unit, take the best and leftmost, drop it by its draw or merge it."""
    row = int.from_bytes(hashlib.blake2b(f"{p.seed}:{key}".encode(), digest_size=8).digest(), "little")
    mixed = lambda x, k: int(pieces.mix(np.array([x % 2**64], np.uint64), k)[0])
    out, number = [], 0
    for k, part in enumerate(text.split(pieces.SPACE)):
        if k:
            out += p.bytes_at[list(pieces.SPACE.encode())].tolist()
            number += 1
        part = part.replace(" ", pieces.SPACE)
        for unit in pieces.UNIT.findall(pieces.SPACE + part if k == 0 and text else part):
            base = mixed(row + number * 0xC2B2AE3D27D4EB4F, 30)
            sym, dropped, turn = list(unit), set(), 0  # dropped: pairs of the places of two symbols' first and next signs
            names = {i: n for n, i in p.ids.items()}
            while True:
                place = np.cumsum([0, *map(len, sym)]).tolist()
                found = [(p.by_rank.tolist().index(p.ids[a + b]), i) for i, (a, b) in enumerate(zip(sym, sym[1:], strict=False)) if a + b in p.ids and a in p.ids and b in p.ids and (place[i], place[i + 1], place[i + 2]) not in dropped]
                if not found:
                    break
                rank, i = min(found)
                turn += 1
                if mixed(base + (turn - 1) * 0x9E3779B97F4A7C15, 31) >> 32 < p.limit:
                    dropped.add((place[i], place[i + 1], place[i + 2]))
                else:
                    sym[i : i + 2] = [names[int(p.by_rank[rank])]]
            for x in sym:
                out += [p.ids[x]] if x in p.ids else p.bytes_at[list(x.encode())].tolist()
            number += 1
    return out


def test_dropout_is_the_plain_agenda(docs):
    """Each occurrence of a unit draws on its own, in short units, long ones, and next to a literal mark."""
    p = pieces.Pieces(pieces.model_path(), 0.3, 5)
    texts = [*[(t or "")[:60] for t in list(docs.values())[:12]], "the the the the", "a\u2581b \ufdd0\n\ufdd0 \u2581", "understandingly" * 4, "", "\U0001f600 x"]
    keys = [str(k) for k in range(len(texts))]
    made = [np.frombuffer(x, p.kind).tolist() for x in p.encode(texts, keys)]
    assert made == [plain_dropout(p, t, k) for t, k in zip(texts, keys, strict=True)]
    assert [p.decode(np.array(m)) for m in made] == texts
    one = p.encode(["wonderfully " * 3000], ["k"])[0]
    kinds = {p.decode(np.array([i])) for i in np.frombuffer(one, p.kind).tolist()}
    assert len(kinds) > 20  # one word has many segmentations


def test_long_units_take_little_time():
    import time

    p, began = pieces.Pieces(pieces.model_path()), time.time()
    text = "".join(np.random.default_rng(3).choice(list("etaoinshr"), 300_000))
    ids = np.frombuffer(p.encode([text], ["k"])[0], p.kind)
    assert p.decode(ids) == text and time.time() - began < 60


def test_dropout_is_lossless_and_seeded(spark, sf):
    rows = pieces.op9_sentencepiece(spark, sf).collect()
    assert all(r.lossless for r in rows) and len(rows) == 200
    a, b = (pieces.Pieces(pieces.model_path(), 0.2, seed) for seed in (1, 2))
    text = "The and attion to thanedble. " * 5
    assert a.encode([text], ["k"]) == a.encode([text], ["k"]) != b.encode([text], ["k"])
    made = pieces.detokenize(pieces.tokenize(odd(spark), pieces.model_path()), pieces.model_path()).collect()
    assert sorted((r.text or "", r.decoded or "") for r in made) == sorted((t or "", t or "") for _, t in ODD)


def test_languages_held_out(spark, sf, docs):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in langid.op10_language_id(spark, sf).collect() if r.held_out and truth[r.doc_id]]
    assert rows and np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    blank = langid.identify(odd(spark, "score"), langid.Model()).collect()
    assert {r.lang_pred for r in blank} == {"und"}


def test_op5_parts_words_of_letters_and_signs_itself():
    """Words of plain letters, digits and signs are put together from their runs; only runs go to the library, each once."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, enc, rng = Tokenizer.from_file(path), token_records.Encoder(path), np.random.default_rng(6)
    calls, plain_ids = [], enc._ids
    enc._ids = lambda word: calls.append(word) or plain_ids(word)
    letters, signs = ["ab", "straße", "x", "naïve", "s", "ll"], ["$$$", "!!", ",***", ".", "-", "_", "7", "42", "(", "@", "%%%"]
    words = [f"{a}{b}{c}{i % 9}" for a in letters for i, b in enumerate(signs) for c in ["", *letters[:3], *signs[:4]]]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(60)] + ["", " ", "it's we'll 's$ a'$b x'7", "ª$ º7 ²$ a\x1cb$ Ā$ é$́"]
    got = enc.encode(texts)
    assert [np.frombuffer(x, enc.kind).tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(calls) == len(set(calls)) and 4 * len(calls) < len(set(" ".join(texts).split()))
    assert enc.encode([]) == [] and enc.encode(["", "\n"]) == [b"", b""]


def test_op5_checksums_of_all_lengths():
    def plain(data: bytes) -> int:
        x = 0xFFFFFFFF
        for b in data:
            x ^= b
            for _ in range(8):
                x = x >> 1 ^ (0x82F63B78 if x & 1 else 0)
        return x ^ 0xFFFFFFFF

    rng = np.random.default_rng(7)
    data = [rng.bytes(n) for n in (*range(20), 1022, 1023, 1024, 1025, 2047, 2048, 2049, 5001)]
    want = [plain(x) for x in data]
    assert token_records.crc32c(data).tolist() == want
    assert [int(token_records.crc32c([x])[0]) for x in data] == want
