import collections
import itertools
import os
import random
import unicodedata

import numpy as np
import pytest
import regex

from lexmill.llm import leakage, lookalike, neardup, pieces, queries, spans, tokenize

VOCABULARY = os.environ.get("LEXMILL_VOCABULARY", tokenize.DEFAULT_VOCABULARY)


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


# 1: near duplicates


def jaccard(x, y):
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("width,threshold,block", [(3, "0.6", 2), (5, "0.8", 512)])
def test_near_duplicates_match_all_pairs(spark, monkeypatch, width, threshold, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    for name in ("ROWS", "MEETINGS", "COPIES") if block == 2 else ():
        monkeypatch.setattr(neardup, name, 3)
    random.seed(1)
    lexicon = [f"w{k}" for k in range(60)] + ["Ünï", "Straße", "x1"]
    base = [[random.choice(lexicon) for _ in range(random.randint(5, 40))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(4):
            c = list(b)
            for _ in range(random.randint(0, 3)):
                c[random.randrange(len(c))] = random.choice(lexicon)
            texts.append(random.choice([" ", "  ", ", "]).join(c).upper() if random.random() < 0.2 else ". ".join(c))
    texts += [texts[0]] * 20 + [None, "", "  ", "too short", "a " * 40]
    rows = [("D", str(k), t, "extra") for k, t in enumerate(texts)] + [("D", "0", texts[0], "again")]
    # one key with two texts
    rows += [("D", "two", texts[1], ""), ("D", "two", texts[2], ""), ("D", "three", texts[1], ""), ("D", "three", texts[2], "")]
    df = spark.createDataFrame(rows, "doc_id string, clause_id string, clause_text string, a string")
    keys = ["doc_id", "clause_id"]
    members, pairs = neardup.near_duplicates(df, keys, "clause_text", width, threshold, 12)
    got = {(r.a_clause_id, r.b_clause_id) for r in neardup.similar_pairs(members, pairs, keys).collect()}
    sets = collections.defaultdict(list)
    for _, c, t, _ in rows:
        if t and len(words(t)) >= 12:
            sets[c].append(set(zip(*[words(t)[i:] for i in range(width)])))
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if any(jaccard(x, y) >= float(threshold) for x in sets[a] for y in sets[b])}
    assert got == want and want
    once = neardup.similar_pairs(members, pairs, keys)
    assert once.count() == len(want)
    single = members.where("clause_id not in ('two', 'three')")
    want = {p for p in want if not {"two", "three"} & set(p)}
    sets = {c: x for c, x in sets.items() if c not in ("two", "three")}
    links = {r.clause_id: r.n_links for r in neardup.links(single, pairs, keys).collect()}
    degree = collections.Counter(x for p in want for x in p)
    assert links == {k: degree[k] for k in sets}


def test_links_have_every_record_and_groups(spark, tmp_path):
    words = [f"w{k}" for k in range(60)]
    # a chain: each text is like the next one, but not like the one after
    rows = [("D", f"chain{k}", " ".join(words[3 * k : 3 * k + 20])) for k in range(9)]
    rows += [("D", "copy", rows[8][2].upper()), ("D", "alone", " ".join(f"x{k}" for k in range(20))), ("D", "short", "Same words"), ("E", "short", "same  WORDS"), ("E", "null", None), ("E", "blank", " ")]
    spark.createDataFrame(rows + rows[:3], "doc_id string, clause_id string, clause_text string").write.parquet(f"{tmp_path}/clauses.parquet")
    got = queries.p1_links(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.clause_id) for r in got) == sorted((d, c) for d, c, _ in rows)
    told = {(r.doc_id, r.clause_id): r for r in got}
    chain = [told["D", c] for _, c, _ in rows[:10]]
    assert [r.n_links for r in chain] == [1, 2, 2, 2, 2, 2, 2, 3, 2, 2]
    assert len({r.group_id for r in chain}) == 1 and told["D", "alone"].group_id == told["D", "alone"].class_id != chain[0].group_id
    rest = [told["D", "short"], told["E", "short"], told["E", "null"], told["E", "blank"]]
    assert all(r.n_links == 0 and r.group_id is None for r in rest)
    assert rest[0].class_id == rest[1].class_id and rest[2].class_id is None


def test_postings_of_long_texts(spark, monkeypatch):
    """No shuffle's files outlive the call, and the bounds tell long texts of common stretches apart."""
    random.seed(2)
    stretches = [" ".join(f"w{random.randrange(400)}" for _ in range(8)) for _ in range(500)]
    texts = [" ".join(random.sample(stretches, 60)) for _ in range(120)]
    texts.append(texts[7] + " and more")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before = shuffled()
    pairs = neardup.near_duplicates(df, ["id"], "t", 3, "0.6", 12)[1]
    assert shuffled() <= before
    assert pairs.count() == 1
    met, segments = [], neardup.segments
    monkeypatch.setattr(neardup, "segments", lambda classes, *rest: met.append(classes.count()) or segments(classes, *rest))
    neardup.near_duplicates(df, ["id"], "t", 3, "0.6", 12)
    assert met == [2]


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id string, t string")
    assert neardup.similar_pairs(*neardup.near_duplicates(df, ["id"], "t"), ["id"]).count() == 0


# 2: pieces


def check_pieces(found, text, limit=512, overlap=64):
    found = sorted(found, key=lambda r: r.piece_no)
    assert [r.piece_no for r in found] == list(range(len(found)))
    assert found[0].piece_start == 0 and found[-1].piece_end == len(text)
    for r in found:
        assert r.piece_text == text[r.piece_start : r.piece_end] and max(1, len(r.piece_text) // 4) <= limit
    before = 0
    for a, b in zip(found, found[1:]):
        assert a.piece_start < b.piece_start < a.piece_end < b.piece_end and (a.piece_end - b.piece_start) // 4 <= overlap
        # no word end lies in the piece beyond the end of the one before
        ends = [e for e in range(max(a.piece_start + 1, before + 1), a.piece_end) if text[e].isspace() and not text[e - 1].isspace()]
        before = a.piece_end
        assert text[a.piece_end].isspace() or text[a.piece_end - 1] in "。！？" or not ends


def oversized():
    random.seed(4)
    prose = lambda n: "".join(random.choice(["word ", "Sentence ends. ", "\n\n", "\n", "é😀 ", "longer-word "]) for _ in range(n))
    return ["", None, "short", "x" * 2051, "x" * 2052, "y" * 100_000, "é" * 5000, " " * 9000, prose(300), prose(3000), prose(30_000), "漢字。" * 4000, "a " * 2000 + "b" * 6000, ("c " * 900 + "\n\n") * 50, "word " * 6320 + "t" * 1500 + " word" * 700, ("s" * 2040 + " ") * 40]


@pytest.mark.parametrize("size", [4096, pieces.RANGE])
def test_pieces(spark, size):
    texts = oversized()
    rows = [("t", k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[9]], "item string, key int, text string")
    got = collections.defaultdict(list)
    for r in pieces.split_oversized(df, ["item", "key"], "text", size=size).collect():
        got[r.key].append(r)
    assert set(got) == {k for k, t in enumerate(texts) if t and len(t) // 4 > 512}
    for k, found in got.items():
        check_pieces(found, texts[k])


def test_pieces_of_files_match_the_texts(spark, tmp_path):
    texts = {f"f {k}%20.txt": t for k, t in enumerate(oversized()) if t is not None}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    got = collections.defaultdict(list)
    for r in pieces.split_files(spark, [str(tmp_path)], size=16_384).collect():
        got[r.path.rsplit("/", 1)[-1]].append(r)
    assert set(got) == {n for n, t in texts.items() if t}
    for name, found in got.items():
        check_pieces(found, texts[name])


# 3: one form


def in_form(text):
    if unicodedata.normalize("NFC", "".join(map(lookalike.plain, text))) != text:
        return False
    scripts = lambda w: {s for c in w for s in ("LATIN", "GREEK", "CYRILLIC") if unicodedata.name(c, "").startswith(s)}
    return all(len(scripts(w)) < 2 for w in regex.findall(r"\p{L}+", text))


TEXTS = [
    None, "", "plain ascii\ttext\n", "Ｔａｒｉｆｆ　Βoard", "café", "café", "ą́ ą́", "zero​width", "no break", "ﬁne ﬂow", "Мир и Рим", "Hаrbour", "Ελλάδα", "x²½ “q” – №™",
    "ひらがな 漢字。", "ｶﾞ", "हिन्दी", "क‍ष", "Kelvin K", "​", "Ж" "w", "한국어", "한", "é" * 3000, "́start", "pаypаl-Ωmega", "ё" "vil", "ﻻ ﷲ", "aᅟb", "ㅤ",
]


def test_consistent_form(spark):
    df = spark.createDataFrame([(str(k), t, "x") for k, t in enumerate(TEXTS)] + [("3", TEXTS[3], "y")], "key string, text string, stretch string")
    got = {r.key for r in lookalike.inconsistent(df, ["key"], "text").collect()}
    assert got == {str(k) for k, t in enumerate(TEXTS) if t and not in_form(t)}
    out = lookalike.consistent(df, "text").collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        assert (r.consistent_text is None) == (r.text is None)
        if r.text and in_form(r.text):
            assert r.consistent_text == r.text
        elif r.text and r.text not in ("Жw", "pаypаl-Ωmega"):  # letters that look like none of the other script
            assert in_form(r.consistent_text)
    forms = {r.text: r.consistent_text for r in out}
    assert forms["Ｔａｒｉｆｆ　Βoard"] == "Tariff Board" and forms["café"] == "café" and forms["Hаrbour"] == "Harbour" and forms["ﬁne ﬂow"] == "fine flow"


def test_recomposition_matches_the_public_rules():
    random.seed(11)
    parts = [chr(k) for k in (0x61, 0x41, 0x301, 0x323, 0x327, 0x308, 0x304, 0x1100, 0x1161, 0x11A8, 0xAC00, 0x9C7, 0x9BE, 0x915, 0x93C, 0x1F600, 0x338, 0x3D, 0x345, 0x3B1, 0x314, 0x1161, 0x11A7)]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 9))) for _ in range(6000)]
    texts += [chr(k) for k in range(0x21, 0x110000, 7) if not 0xD800 <= k < 0xE000]
    assert lookalike.composed_texts([unicodedata.normalize("NFD", t) for t in texts]) == [unicodedata.normalize("NFC", t) for t in texts]
    assert lookalike.composed_texts([]) == [] and lookalike.composed_texts([""]) == [""]


def test_public_lookalikes(spark):
    known = {r.ch: r for r in lookalike.lookalikes(spark).collect()}
    assert len(known) > 200 and (known["а"].latin, known["ѕ"].latin, known["ԛ"].latin) == ("a", "s", "q")
    assert all(getattr(r, unicodedata.name(c).split(" ")[0].lower()) == c for c, r in known.items())


def test_many_forms_join_by_salt(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "broadcast_if_small", lambda df, *_: df)
    df = spark.createDataFrame([(k, "Ｔａｒｉｆｆ now" if k % 3 else "plain é") for k in range(90)], "key int, text string")
    assert lookalike.inconsistent(df, ["key"], "text").count() == 60
    assert {r.consistent_text for r in lookalike.consistent(df, "text").collect()} == {"Tariff now", "plain é"}


# 6: encoding


def encoded(texts):
    ids, counts = tokenize.Encoder(tokenize.load_merges(VOCABULARY)).encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_encoding_matches_the_public_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    random.seed(2)
    parts = [" ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", " ", "a", "'s", "'", "é", "é", "1", "١", "漢", "😀", "<|endoftext|>", "aaaa", "​", "...", "'ll", "hello", "　"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(4000)] + ["z" * 3000, "ab" * 500]
    assert encoded(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_encoding_of_a_table(spark):
    df = spark.createDataFrame([(1, "Hello world", "a"), (2, "", "b"), (3, None, "c"), (1, "Hello world", "a"), (4, " \n ", "d")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in tokenize.encode_corpus(df, vocabulary=VOCABULARY).collect())
    assert got == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, []), (4, [220, 198, 220])] or got[:4] == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_forgetting_changes_nothing():
    texts = ["one two\nthree", "two three\n\none", None, "four"] * 20
    e = tokenize.Encoder(tokenize.load_merges(VOCABULARY), most_words=2, most_ids=3)
    parts = [e.encode([t])[0].tolist() for t in texts]
    assert parts == encoded(texts)


# 7: leaks


def test_leaks_match_brute_force(spark):
    random.seed(5)
    lexicon = ["the", "Über", "river", "Marholm", "1906", "km", "İstanbul", "crossed", "a", "Σίσυφος", "7th", "Venice", "old"]
    item = lambda n: [random.choice(lexicon) for _ in range(n)]
    items = [item(random.randint(5, 30)) for _ in range(30)]
    docs = []
    for _ in range(80):
        d = item(random.randint(0, 30))
        src = random.choice(items)
        k = random.randint(0, len(src))
        d += src[k : k + random.randint(8, 20)] + item(5)
        docs.append(random.choice([" ", "''' ", "\n\n* ", "<b>"]).join(d))
    rows_i = [(k, " ".join(x)) for k, x in enumerate(items)] + [(98, None), (99, ""), (0, " ".join(items[0]))]
    rows_d = [(k, x) for k, x in enumerate(docs)] + [(900, None), (901, ""), (902, " ".join(items[3]).upper()), (0, docs[0])]
    got = {(r.item_id, r.doc_id) for r in leakage.leaks(spark.createDataFrame(rows_i, "item_id long, text string"), spark.createDataFrame(rows_d, "doc_id long, text string")).collect()}
    grams = lambda t: {tuple(words(t)[k : k + 13]) for k in range(len(words(t)) - 12)} if t else set()
    g = {k: grams(t) for k, t in rows_i}
    want = {(i, d) for d, t in rows_d for i in g if grams(t) & g[i]}
    assert got == want and want


def test_reparameterised(spark):
    # 13 words, so one window: consistency is told window by window
    q = "In {} the {} bridge near {} was built by {} in {}"
    items = spark.createDataFrame([(1, q.format(1906, "old", "Marholm", 300, 90)), (2, "in the old bridge was built by near")], "item_id long, text string")
    docs = spark.createDataFrame([(1, q.format(1951, "old", "Venholt", 421, 33)), (2, q.format(1951, "old", "Venholt", 421, 421)), (3, q.format(1906, "old", "Marholm", 300, 90))], "doc_id long, text string")
    assert [(r.item_id, r.doc_id) for r in leakage.reparameterised(items, docs).collect()] == [(1, 1)]


def planted():
    """Items, documents that hold one with other numbers and names, and decoys: slots that don't map one to one, another
    literal word, numbers alone. (item, document) of the former."""
    random.seed(12)
    plain = "the old river crosses under bridge near town and was built by after people came from over hill with stone".split()
    names = lambda: random.choice("BDGKLMPRSTV") + "".join(random.choice("aeiou") + random.choice("lmnrst") for _ in range(3))
    number = lambda: random.choice([str(random.randint(2, 999)), f"{random.randint(1, 9)},{random.randint(100, 999)}", f"{random.randint(1, 99)}.5"])
    items, docs, want = [(0, " ".join(plain)), (1, None), (2, "1 2 3 4 5 6 7 8 9 10 11 12 13 14")], [(0, None), (1, " ".join(map(str, range(40, 80))))], set()
    for k in range(3, 43):
        form = [random.choice(plain) for _ in range(random.choice([5, 6, 12, 16]))]
        slots = sorted(random.sample(range(len(form)), 3))
        unit = random.choice(["", "", "km", "th"])
        first, second = ([names(), f"{random.randint(2, 999)}{unit}" if unit else number(), names()] for _ in range(2))
        fill = lambda values: [dict(zip(slots, values)).get(j, w) for j, w in enumerate(form)]  # noqa: B023, E731
        own = fill(first)
        items.append((k, " ".join(own)))
        lead = [random.choice(plain) for _ in range(4)]
        docs.append((k, " ".join(lead + fill(second)) + " . " + " ".join(lead)))
        if len(form) >= 6:
            want.add((k, k))
        docs.append((1000 + k, " ".join(fill([second[0], second[1], second[0]]))))
        other = list(fill(second))
        other[next(j for j in range(len(form)) if j not in slots and len(form) // 2 - 1 <= j)] = "hill" if form[len(form) // 2] != "hill" else "stone"
        docs.append((2000 + k, " ".join(other)))
    return items, docs, want


@pytest.mark.parametrize("literals,points", [(leakage.BROADCAST_LITERALS, leakage.POINTS), (3, 600)])
def test_planted_reparameterised_items(spark, monkeypatch, literals, points):
    monkeypatch.setattr(leakage, "BROADCAST_LITERALS", literals)
    monkeypatch.setattr(leakage, "POINTS", points)
    items, docs, want = planted()
    i, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs + docs[:5], "doc_id long, text string")
    got = {(r.item_id, r.doc_id) for r in leakage.reparameterised(i, d).collect()}
    assert len(got & want) >= 0.9 * len(want)
    # an item of several windows may hold one of the two equal slots only
    size = {k: len((t or "").split()) for k, t in items}
    assert not any(doc in (0, 1) or item in (1, 2) or 1000 <= doc < 2000 and item == doc - 1000 and size[item] < 13 for item, doc in got)
    verbatim = {(r.item_id, r.doc_id) for r in leakage.leaks(i, d).collect()}
    grams = lambda t: {tuple(words(t)[k : k + 13]) for k in range(len(words(t)) - 12)} if t else set()
    assert verbatim == {(a, b) for a, x in items for b, y in docs if grams(x) & grams(y)}


def test_long_texts_in_pieces():
    random.seed(3)
    text = " ".join(random.choice(["word", "1,250", "x" * 30, "a.b", "15km"]) for _ in range(3000)) + "!" * 2000 + " end of it " + "y" * 900
    whole = {tuple(x) for _, *w in leakage.windows_of([text], None, np.sort(leakage.word_hash(["word"])), np.sort(leakage.word_hash(["km"])), None, [13], False, False) for x in zip(*(v.tolist() for v in w))}
    for most in (500, 3000):
        parts = list(leakage.in_pieces(text, 13, most))
        assert len(parts) > 2 and parts[-1] and text.endswith(parts[-1])
        found = set()
        for p in parts:
            found |= {tuple(x) for _, *w in leakage.windows_of([p], None, np.sort(leakage.word_hash(["word"])), np.sort(leakage.word_hash(["km"])), None, [13], False, False) for x in zip(*(v.tolist() for v in w))}
        assert found == whole


def test_more_windows_than_a_pass_takes(spark, monkeypatch):
    monkeypatch.setattr(leakage, "WINDOWS_A_PASS", 5)
    text = " ".join(f"w{k}" for k in range(30))
    items = spark.createDataFrame([(1, text), (2, "other " * 20)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + text), (2, None)], "doc_id long, text string")
    assert [(r.item_id, r.doc_id) for r in leakage.leaks(items, docs).collect()] == [(1, 1)]


# 8: shared spans


def brute_spans(rows, least):
    pages = {}
    for d, p, t in rows:
        for k in range(len(t or "") - least + 1):
            pages.setdefault(t[k : k + least], set()).add(p if p is not None else f"doc {d}")
    out = set()
    for d, p, t in rows:
        hit = [k for k in range(len(t or "") - least + 1) if len(pages[t[k : k + least]]) > 1]
        run = None
        for k in hit:
            if run and k <= run[1]:
                run[1] = k + least
            else:
                if run:
                    out.add((d, *run))
                run = [k, k + least]
        if run:
            out.add((d, *run))
    return out


def span_rows():
    random.seed(6)
    text = lambda n: "".join(random.choice("abcdefgh éΣ漢\n") for _ in range(n))
    shared = [text(random.randint(150, 700)) for _ in range(8)]
    rows = []
    for k in range(60):
        own = text(random.randint(0, 300))
        for _ in range(random.randint(0, 3)):
            s = random.choice(shared)
            a = random.randint(0, len(s) // 2)
            own += s[a : a + random.randint(100, 600)] + text(random.randint(0, 80))
        rows.append((k, random.randint(1, 20), own))
    hot = text(205)
    rows += [(100 + k, 30 + k % 9, text(170) + hot + text(170)) for k in range(30)]
    rows += [(200, 1, None), (201, 2, ""), (202, None, shared[0] * 2), (203, 40, "z" * 900), (204, 41, "z" * 500), rows[0]]
    return rows


@pytest.mark.parametrize("hot,shard", [(spans.HOT, spans.CLASSES_A_SHARD), (3, 20)])
def test_shared_spans_match_brute_force(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(spans, "CLASSES_A_SHARD", shard)
    rows = span_rows()
    df = spark.createDataFrame(rows, "doc_id long, page_id long, text string")
    got = {tuple(r) for r in spans.shared_spans(df, hot=hot).collect()}
    assert got == brute_spans(list(dict.fromkeys(rows)), 200) and got
    share = {r.doc_id: r for r in spans.shared_share(df, spans.shared_spans(df, hot=hot)).collect()}
    assert share[203].shared_chars == 900 and share[203].share == 1.0 and share[200].n_chars == 0


def test_backward_search_finds_every_substring():
    random.seed(8)
    texts = [np.array([random.randint(1, 3) for _ in range(random.randint(1, 40))]) for _ in range(12)]
    index = spans.FmIndex(texts, np.arange(12), 3, 80)
    strings = ["".join(map(str, t)) for t in texts]
    for n in (1, 2, 4, 7):
        for p in itertools.islice(itertools.product("123", repeat=n), 300):
            low, high = np.array([0]), np.array([index.n])
            for c in reversed(p):
                low, high = index.extend(low, high, np.array([int(c)]))
            assert int(high[0] - low[0]) == sum("".join(p) == s[k : k + n] for s in strings for k in range(len(s)))


def test_long_text_in_stretches():
    text = "".join(random.choice("abc") for _ in range(5000))
    for a, b in ((5000, 199), (700, 199)):
        seen = {}
        from lexmill.llm import textarrays

        for points, rows, starts, offsets in textarrays.batches_of_texts([text, None, "x"], a, b):
            for k in range(len(rows)):
                for j, c in enumerate(points[starts[k] : starts[k + 1]]):
                    assert seen.setdefault((int(rows[k]), int(offsets[k]) + j), chr(c)) == chr(c)
        assert "".join(seen[(0, k)] for k in range(5000)) == text and seen[(2, 0)] == "x"
