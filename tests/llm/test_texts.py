import random
import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.llm.contamination import build_index, find_leaks, search_index, words_of
from shoebox.llm.mixing import mix, source_key, weighed
from shoebox.llm.scans import Lexicon, Page, Titles, decode, number_of, paragraphs, repair, repair_pages, words_to_count
from shoebox.llm.splitting import plan, split_text, split_texts
from shoebox.llm.tokens import RANKS, encoder, ship, token_count
from tests.test_operators import rows

WORDS = [a + b for a in "ba ce di fo gu ka le mi no pu ra se ti vo".split() for b in "lan mor nik rus tel vad wyn".split()]


# --- leaks ---------------------------------------------------------------------------------------------------------


def brute_leaks(docs, items, run=16, one_in=8):
    known = {w for _, t in items if len(words_of(t)) >= run for w in words_of(t)}
    out = set()
    for d, text in docs:
        w = words_of(text, known)
        for i, item in items:
            v = words_of(item)
            for shift in range(-len(v), len(w)):
                same = [0 <= shift + k < len(w) and w[shift + k] == v[k] for k in range(len(v))]
                for lo in range(len(v)):
                    for hi in range(lo + run, len(v) + 1):
                        if same[lo] and same[hi - 1] and (hi - lo - sum(same[lo:hi])) * one_in <= hi - lo:
                            out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    r = random.Random(3)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(10, 40)))) for i in range(12)]
    docs = []
    for d in range(60):
        v = r.choice(items)[1].split()
        n = r.randrange(8, 34)
        at = r.randrange(max(1, len(v) - n + 1))
        part = v[at : at + n]
        for _ in range(r.randrange(5)):
            part[r.randrange(len(part))] = r.choice(WORDS)
        if r.random() < 0.2:
            r.shuffle(part)
        text = " ".join([r.choice(WORDS) for _ in range(r.randrange(20))] + part + [r.choice(WORDS) for _ in range(r.randrange(20))])
        if d % 2:  # lines that end anywhere, also within words
            text = "".join(c + (r.choice(["\n", "-\n", "- "]) if r.random() < 0.06 and c.isalpha() else "") for c in text)
        docs.append((d, text))
    a = spark.createDataFrame([*docs, (900, None), (901, " "), (None, docs[0][1])], "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    b = spark.createDataFrame([*items, (99, None), (98, ""), (97, "too few words")], "item_id bigint, text string")
    got = find_leaks(a, b)
    want = brute_leaks(docs, items)
    assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == want and len(want) > 10
    index = build_index(a.coalesce(1), words_per_block=150).persist()
    assert index.count() > 5
    assert {(x["doc_id"], x["item_id"]) for x in search_index(index, b).collect()} == want
    later = search_index(index, b.where("item_id in (3, 4)"))
    assert {(x["doc_id"], x["item_id"]) for x in later.collect()} == brute_leaks(docs, [x for x in items if x[0] in (3, 4)])
    assert rows(find_leaks(a.limit(0), b)) == [] and rows(find_leaks(a, b.limit(0))) == []


def test_forms_of_one_passage(spark):
    item = "Name every ﬁne harbour whose naïve lantern passed between Lomor and Tandor, kept 42 sandy boats near the old pier at dawn today"
    plain = item.replace("ﬁ", "fi")
    forms = [
        plain.upper(), plain.replace(" ", "\n"), plain.replace("lantern", "lan-\ntern"), plain.replace("between", "be\ntween"), "> " + plain.replace("passed", "passed\n> "),
        plain.replace("harbour", "**harbour**").replace("kept", "<i>kept</i>"), plain.replace("naïve", "naïve"), plain.replace("sandy", "sand- y"), "- " + plain.replace(",", " — \n- "),
        plain.replace("lantern", "lan­tern"), plain.replace("kept", f'<a href="{"x/" * 500}">kept</a>'),
    ]
    docs = spark.createDataFrame([(i, f"So it goes. {t} And more") for i, t in enumerate(forms)], "doc_id bigint, text string")
    got = find_leaks(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["replaced"]) for r in got} == {(i, 0) for i in range(len(forms))}


# --- pages ---------------------------------------------------------------------------------------------------------


def lexicon(words="the old harbour lantern was carried by a gentle fisherman and he kept it near lomor short long well known range every quiet".split()):
    return Lexicon({w: 60 for w in words} | {"lantem": 1}, {"short": 30, "well": 20, "long": 20})


def words_of_stream(text, lex):
    words, broken, misread = decode(text.split(), lex)
    return " ".join(w.word for w in words), broken, misread


def test_decoding():
    lex = lexicon()
    for seen, want, broken, misread in [
        ("the old lan- tern was carried", "the old lantern was carried", 1, 0), ("the 0ld harbour", "the old harbour", 0, 1), ("thc lantem was carriecl", "the lantern was carried", 0, 3),
        ("short- and long-range", "short- and long-range", 0, 0), ("fisher¬ rnan kept", "fisherman kept", 1, 1), ("every qui et lantern", "every quiet lantern", 0, 0), ("well-kn0wn harbour", "well-known harbour", 0, 1),
        ("the old lan te rn was", "the old lantern was", 0, 0), ("theoldharbour was kept", "the old harbour was kept", 0, 0), ("har- bo- ur, near", "harbour, near", 2, 0),
        ("theoldlan- tern", "the old lantern", 1, 0), ("theoldharb0ur.", "the old harbour.", 0, 1), ("the har bour", "the harbour", 0, 0), ("he kept", "he kept", 0, 0),
    ]:
        got, b, m = words_of_stream(seen, lex)
        assert (got, b, min(m, misread) if misread else m) == (want, broken, misread), seen
    assert decode([], lex) == ([], 0, 0)
    many = Lexicon({"international": 40, "the": 90}, {})
    assert words_of_stream("the inter- nat- ional", many) == ("the international", 2, 0)


def test_unknown_words_are_read_by_their_spelling():
    lex = lexicon()
    text, kinds, _, _ = repair("The ol$xd zqu1kx lantern was carried", lex)
    assert kinds == ["chars"] and "$" not in text and "1" not in text and text.startswith("The olsxd zqu")
    for plain in ("The 2nd lantern of 12mm and F1 was IMG_815", "The harbour Zzyq was kept"):
        assert repair(plain, lex)[:2] == (plain, [])
    assert Lexicon({w: 9 for w in ("cillilliil", "mill")}, {}).meant("c111111111") == ("cillilliil", 9)


def test_page_edges():
    lex = lexicon()
    known = lambda **x: Titles(lex, **x)
    p = Page("Sandy Baker Journal | [149]\nForest and harbour\n\nThe old lantern", known())
    assert p.titles == ["Sandy Baker Journal"] and p.number == 149 and p.body.startswith("Forest and harbour")
    assert Page("Page 12  The Old Lantern\n\nThe harbour was quiet", known()).number == 12
    assert Page("cxlii\nThe harbour was quiet").number == 142 and number_of("iiii") is None and number_of("xciv") == 94
    assert Page("The harbour was quiet\nThe Old Lantern\np. 9", known()).titles == ["The Old Lantern"]
    plain = Page("The harbour was quiet and\nhe kept 12 lanterns near Lomor", known(runs=True))
    assert not plain.titles and plain.number is None
    text = "Every quiet harbour was kept by the old fisherman near Lomor. Known Harbour Range"
    flat = Page(text, known(runs=True))
    assert flat.titles == ["Known Harbour Range"] and flat.body.endswith("Lomor.") and not Page(text, known()).titles
    assert Page("He kept the lantern 15").number is None and Page("He kept the lantern 15", None, 15, "end").number == 15
    for text in ("", "\n\n", "7", "[3]", "|", "- -"):
        Page(text, known(runs=True))


def test_titles_need_more_than_their_shape():
    lex = lexicon()
    rest = "\nThe old lantern was carried by a gentle\nfisherman."
    for few in (False, True):
        for name in ("Maria Anna Schmidt", "Quiet Anna Schmidt"):
            assert Page(name + rest, Titles(lex, few=few, runs=few)).body.startswith(name)
    assert not Page("The Old Lantern" + rest, Titles(lex)).titles and Page("The Old Lantern" + rest, Titles(lex, few=True)).titles
    for title in ("the quiet harbour journal", "A Short History of the Old Harbour Lantern", "Lomor"):
        own = Titles(lex, agreed={title.lower(): 2}, runs=True)
        assert Page(title + rest, own).titles == [title] and Page(f"{title} the old lantern was carried by a gentle fisherman.", own).titles == [title]
    two = Page("The 0ld Lantern\nHe kept the har-\n\nThe Old Lantern\n\nbour near lomor.", Titles(lex, agreed={"the old lantern": 2}, runs=True))
    chance = Titles(lex, agreed={"old harbour range": 3, "old harbour range the": 2}, runs=True)
    assert Page("Old Harbour Range The lantern was carried by a gentle fisherman", chance).titles == ["Old Harbour Range"]
    assert len(two.titles) == 2 and two.body == "He kept the har-\nbour near lomor."


def test_repair_of_a_page():
    lex = lexicon()
    page = "Gentle Harbour Range\nThe old lan-\ntern was carried by the fisher-\nman.\n\nHe kept it near thc harbour.\n12"
    text, kinds, number, title = repair(page, lex, titles=Titles(lex, few=True))
    assert text == "The old lantern was carried by the fisherman.\n\nHe kept it near the harbour." and number == 12 and title == "Gentle Harbour Range"
    assert kinds == ["chars", "header", "hyphen", "pageno"]
    assert repair("The old lantern was carried", lex)[1] == []
    assert repair("The old lantern was car-", lex)[:2] == ("The old lantern was car", ["hyphen"]) and repair("The old lantern was short-", lex)[1] == []
    assert repair("", lex)[0] == "" and repair(" \n ", lex)[1] == []
    assert paragraphs([]) == [] and paragraphs([("A.", 0.0)]) == ["A."]
    # as many short sentences as make a paragraph of usual length stay together
    assert len(paragraphs([("Ab c.", -2.0)] * 100)) == 1


def test_lexicon_tells_misreadings():
    counts = {"lantern": 100, "lantcrn": 2, "harbour": 50, "rare": 2, "once": 1}
    lex = Lexicon(counts, {})
    assert "lantern" in lex and "lantcrn" not in lex and "rare" in lex and "once" not in lex
    assert lex.meant("lantcrn")[0] == "lantern" and lex.meant("harb0ur") == ("harbour", 1) and lex.meant("zzz") is None
    a, b, c = words_to_count("The lan- tern was short- and long-range")
    assert "lan" not in a and "tern" not in a and b["short"] == 1 and c == {"the": 1}


def test_repair_pages(spark):
    line = "the old harbour lantern was carried by a gentle fisherman and he kept it near the harbour every quiet evening"
    data = [(i, f"s{i % 3}", i, f"{line} {line}", 0) for i in range(30)]
    data += [(100, "s", 1, line + ". 51", 0), (101, "s", 2, line + ". 52", 0), (102, "s", 3, line + " 7", 0), (103, "s", None, None, 0), (104, None, None, " ", 0), (105, "t", 1, "The 0ld harb-\nour", 0), (105, "t", 1, "The 0ld harb-\nour", 0)]
    long_title = "a short known range of every old harbour lantern"
    data += [(200 + i, "u", i, t + "\nThe " + line + ".", 0) for i, t in enumerate(["the quiet harbour journal", "the qu1et harbour journal", "Maria Anna Schmidt", long_title, long_title, "Jane Doe"])]
    df = spark.createDataFrame(data, "id bigint, scan string, place int, text string, kinds int")
    got = {r["id"]: r for r in repair_pages(df, df).collect()}
    assert got[100]["page_number"] == 51 and got[101]["kinds"] == ["pageno"] and got[102]["kinds"] == []
    assert got[200]["title"] == got[201]["title"] == "the quiet harbour journal" and got[202]["title"] is None and got[203]["title"] == "a short known range of every old harbour lantern"
    assert got[103]["text"] is None and got[103]["kinds"] == [] and got[104]["text"] == "" and got[105]["kinds"] == ["chars", "hyphen"]
    assert repair_pages(df, df).count() == len(data) and repair_pages(df.limit(0), df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "s", 1, (line + "\n") * 3000)], "id bigint, scan string, place int, text string")
    assert len(repair_pages(long, df).first()["text"]) > 3000 * 100


# --- pieces --------------------------------------------------------------------------------------------------------


def texts(seed):
    r = random.Random(seed)
    out = ["", " ", "a", "x" * 3000, "é" * 900, "\n" * 2500, "日本語の文章です。" * 400, "word " * 5000]
    for _ in range(12):
        parts = [" ".join(r.choice(WORDS) for _ in range(r.randrange(3, 30))).capitalize() + r.choice([". ", "!\n", ".\n\n", " "]) for _ in range(r.randrange(1, 300))]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("limit,overlap", [(100, 10), (1000, 50), (64, 0), (40, 39)])
def test_pieces(limit, overlap):
    code = encoder()
    for text in texts(limit):
        n = len(code.encode_ordinary(text))
        if overlap == 39 and n > 500:
            continue
        parts = split_text(text, limit, overlap)
        assert (len(parts) > 1) == (n > limit)
        assert parts[0][0] == 0 and parts[-1][1] == len(text)
        for a, b in zip(parts, parts[1:]):
            assert a[0] <= b[0] <= a[1] < b[1]  # nothing between pieces is lost
            if overlap:
                assert b[0] < a[1]
        for a, b, _ in parts:
            assert len(code.encode_ordinary(text[a:b])) <= limit
        if n > limit:
            assert len(parts) >= -(-(n - overlap) // (limit - overlap))


def test_cuts_are_natural():
    text = ("one two three four five. " * 20 + "\n\n") * 12
    parts = split_text(text, 200, 0)
    assert all(text[:b].rstrip().endswith(".") for _, b, _ in parts) and any(text[b - 1] == "\n" for _, b, _ in parts[:-1])
    sizes = [n for _, _, n in parts]
    assert max(sizes) - min(sizes) <= 110
    assert plan(10, 5, 0, np.full(11, 1), 2) == [5] and plan(10, 4, 0, np.full(11, 1), 2) is None


def test_split_texts(spark):
    data = [(1, "short", 5), (2, None, 5), (None, "word " * 1200, 5), (3, "word " * 1200, 5), (3, "word " * 1200, 5), (4, "", 5)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, piece int")
    got = split_texts(df)
    assert rows(got.where("pieces = 1"), "doc_id", "text", "tokens") == [(1, "short", None), (4, "", None)]
    assert got.where("doc_id = 3").count() == 4 and got.where("doc_id is null").count() == 2
    assert split_texts(df, keep_small=False, with_text=False).columns == ["doc_id", "piece", "pieces", "start", "end", "tokens"]
    assert split_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_texts(df, limit=10, overlap=10)


# --- mixes ---------------------------------------------------------------------------------------------------------

DOC, TARGET = "doc_id bigint, source string, tokens bigint, weight double, copies int", "source string, target_share double, max_repeats int"


def test_mix(spark):
    r = random.Random(1)
    data = [(i, ["big", "Big ", "big"][i % 3], r.randrange(50, 150), r.random(), 0) for i in range(600)] + [(1000 + i, "small-one", 100, 1.0, 0) for i in range(30)]
    data += [(2000, None, 100, 1.0, 0), (2001, "other", 100, 1.0, 0), (2002, "big", None, 1.0, 0), (2003, "big", 0, 1.0, 0), (2004, "big", 100, None, 0), (2005, "big", 100, float("nan"), 0), (1000, "small-one", 100, 1.0, 0)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("SMALL ONE", 0.3, 3), ("absent", 0.1, 5)], TARGET)
    df = spark.createDataFrame(data, DOC)
    selection, report = mix(df, targets)
    told = {x["source"]: x for x in report.collect()}
    assert told["absent"]["selected_tokens"] == 0 and told["small_one"]["most_copies"] == 3
    assert told["small_one"]["actual_share"] == pytest.approx(1 / 3, abs=0.02) and told["big"]["actual_share"] == pytest.approx(2 / 3, abs=0.02)
    chosen = {x["doc_id"]: x for x in selection.collect()}
    assert max(x["copies"] for x in chosen.values() if x["source"] == "big") == 1 and not {2000, 2001, 2002, 2003} & set(chosen)
    assert rows(mix(df, targets)[0], "doc_id", "copies") == rows(selection, "doc_id", "copies")
    heavy = np.mean([d[3] for d in data[:600] if d[0] in chosen])
    assert heavy > np.mean([d[3] for d in data[:600]])
    fixed = {x["source"]: x for x in mix(df, targets, total_tokens=10_000)[1].collect()}
    assert abs(fixed["big"]["selected_tokens"] - 6667) <= 100 and abs(fixed["small_one"]["selected_tokens"] - 3333) <= 100
    much = {x["source"]: x for x in mix(df, targets, total_tokens=10**9)[1].collect()}
    assert much["small_one"]["selected_tokens"] == 3 * 3000
    for a, b in ((df.limit(0), targets), (df, targets.limit(0))):
        assert mix(a, b)[0].count() == 0


def test_the_edge_of_a_budget_is_found_in_ever_smaller_buckets(spark):
    r = random.Random(4)
    data = [(i, "a" if i % 3 else "b", r.randrange(1, 200), r.choice([0.0, 0.2, 1.0, 1.0]), 0) for i in range(3000)]
    df, targets = spark.createDataFrame(data, DOC), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGET)
    for total in (None, 90_000, 7):
        want = rows(mix(df, targets, total)[0], "doc_id", "copies")
        for edge in (1, 40):
            assert rows(mix(df, targets, total, edge_rows=edge)[0], "doc_id", "copies") == want
    got = {x["source"]: x["selected_tokens"] for x in mix(df, targets, 90_000, edge_rows=1)[1].collect()}
    assert all(abs(n - 45_000) <= 200 for n in got.values())


def test_sources_and_weights(spark):
    r = random.Random(2)
    plain = [" ".join(r.choice(WORDS[:20]) for _ in range(60)) for _ in range(60)]
    odd = ["".join(chr(r.randrange(33, 1000)) for _ in range(300)), "balan balan " * 100]
    data = [(i, "Ocr Export" if i % 2 else " ocr-export", t, 0) for i, t in enumerate([*plain, *odd, ""])]
    data += [(90, "one", "a text alone", 0), (91, "other", "no target", 0), (92, None, "x", 0), (93, "one", None, 0), (None, "one", "x", 0)]
    df = spark.createDataFrame(data, "doc_id bigint, source string, text string, tokens int")
    targets = spark.createDataFrame([("ocr_export", 0.5, 1), ("ONE", 0.5, 1), (None, 0.1, 1)], TARGET)
    got = {x["doc_id"]: x for x in weighed(df, targets, smoothing=50.0).collect()}
    assert set(got) == {*range(63), 90} and got[62]["weight"] == 0.05 and got[62]["tokens"] == 0 and got[90]["weight"] == 1
    code = {i: encoder().encode_ordinary(t) for i, _, t, _ in data if i in got}
    counts = np.bincount([c for i in code if i < 90 for c in code[i]], minlength=encoder().n_vocab)
    usual = 1.0 + counts + np.bincount(code[90], minlength=len(counts))
    cost = -np.log((counts + 50 * usual / usual.sum()) / (counts.sum() + 50))
    entropy = {i: cost[code[i]].mean() for i in range(62)}
    mean, spread = np.mean(list(entropy.values())), np.std(list(entropy.values()))
    for i in range(62):
        assert got[i]["tokens"] == len(code[i]) and got[i]["entropy"] == pytest.approx(entropy[i], rel=1e-5)
        assert got[i]["weight"] == pytest.approx(max(0.05, np.exp(-(((entropy[i] - mean) / spread) ** 2) / 2)), abs=1e-4)
    assert got[60]["weight"] == 0.05 and np.mean([got[i]["weight"] for i in range(60)]) > 0.8
    assert weighed(df.limit(0), targets).count() == 0 and weighed(df, targets.limit(0)).count() == 0


def test_token_counts_are_the_tokenizers(spark):
    sample = texts(5)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sample)], "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", token_count(F.col("t"))).collect()}
    assert got == {i: len(encoder().encode_ordinary(t)) for i, t in enumerate(sample)}
    assert re.sub(r"\s", "", encoder().decode(encoder().encode_ordinary(sample[-1]))) == re.sub(r"\s", "", sample[-1])


def test_lexicon_holds_every_word(spark):
    """A word seen twice stays known, though a million others are more frequent."""
    letter = lambda n: F.chr(F.lit(97) + F.pmod(F.floor(F.col("id") / n), F.lit(26)))
    word = F.concat(F.lit("q"), *[letter(26**i) for i in range(5)])
    common = spark.range(1_001_000).groupBy(F.floor(F.col("id") / 1000)).agg(F.concat_ws(" ", F.collect_list(word)).alias("w"))
    common = common.select(F.concat_ws(" ", "w", "w", "w").alias("text"))
    rare = spark.createDataFrame([("zebrine zebrine",)], "text string")
    page = spark.createDataFrame([(1, "s", 1, "ze brine")], "id bigint, scan string, place int, text string")
    assert repair_pages(page, common.unionByName(rare)).first()["text"] == "zebrine"


def test_the_vocabulary_is_shipped(spark, tmp_path):
    """Executors that lack the file read the copy they were sent."""
    own = tmp_path / "shipped.tiktoken"
    shutil.copy(RANKS, own)
    ship(spark, str(own))
    ship(spark, str(own))
    df = spark.createDataFrame([("the old harbour",), (None,)], "t string")
    assert [r[0] for r in df.select(token_count(F.col("t"), "/nowhere/shipped.tiktoken")).collect()] == [len(encoder().encode_ordinary("the old harbour")), 0]
