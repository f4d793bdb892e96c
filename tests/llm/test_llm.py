"""Problems 8 to 10: brute force, planted cases and edge cases."""

import html
import math
import random

import pytest

from reelmill.llm import leakage, mixing, textstats
from reelmill.llm.words import words

VOCABULARY = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]


def sentence(rnd, n):
    return [rnd.choice(VOCABULARY) for _ in range(n)]


def test_words_ignore_disguise():
    plain = words("Der müde Fährmann kaufte die Papierkrone, l'œil de verre")
    assert plain == ["der", "mude", "fahrmann", "kaufte", "die", "papierkrone", "l", "oeil", "de", "verre"]
    assert words("DER  MÜDE\nFÄHRMANN — kaufte\tdie Papier-\n> krone; L’ŒIL de verre") == plain
    assert words("Der m&#252;de Fährmann kau­f​te die Papierkrоne, l'œil dе verre") == plain
    assert words("Der müde Fährmann kaufte die Papierkrone l oeil de verre".encode().decode("cp1252")) == plain
    assert words("") == []


def longest_common(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_automaton_against_brute_force():
    rnd = random.Random(5)
    few = VOCABULARY[:6]
    for _ in range(60):
        items = [(k, [rnd.choice(few) for _ in range(rnd.randrange(1, 25))]) for k in range(3)]
        automaton = leakage.Automaton(items)
        text = [rnd.choice(few) for _ in range(40)]
        seeds = automaton.seeds([automaton.vocabulary.get(t, -1) for t in text])
        want = max(longest_common(text, tokens) for _, tokens in items)
        assert max([n for _, n, _ in seeds], default=0) == (want if want >= leakage.SEED else 0)
        for past, n, state in seeds:
            # every occurrence, and no other position
            run = text[past - n : past]
            where = []
            for k, tokens in items:
                for i in range(len(tokens) - n + 1):
                    if tokens[i : i + n] == run:
                        where.append((k, i + n - 1))
            got = sorted((automaton.owner[e], e - automaton.first[e]) for e in automaton.ends(state))
            assert got == sorted(where)


def test_leaks(spark):
    rnd = random.Random(8)
    a, b, shared = sentence(rnd, 60), sentence(rnd, 60), sentence(rnd, 20)
    c = sentence(rnd, 40)
    items = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b + shared)), (3, " ".join(shared + c)), (4, None), (5, ""), (6, "too short")], "item_id long, text string")
    noise = sentence(rnd, 30)
    altered = a[10:40]
    altered[5] = "altered"
    del altered[20]
    rows = [
        (1, " ".join(noise + a[:25] + noise)),
        (2, " ".join(noise + altered)),
        (3, " ".join(noise + a[20:32] + noise)),  # a short quotation
        (4, " ".join(noise + shared + noise)),  # wording of two items
        (5, " ".join(x.upper() for x in b[30:55]).replace(" ", ",\n")),
        (6, " ".join(a[:30] + noise + b[:30])),
        (7, None),
        (8, ""),
        (9, html.escape("ü ").join(c)),
        (10, " ".join(noise * 3000 + a[:25])),
        (1, " ".join(a[:25])),
    ]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id int")
    got = {tuple(r) for r in leakage.leaked_items(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (5, 2), (6, 1), (6, 2), (10, 1)}
    assert leakage.leaked_items(docs.where("false"), items).count() == 0
    assert leakage.leaked_items(docs, items.where("false")).count() == 0
    cover = {r["doc_id"]: r for r in leakage.coverage(docs.where("doc_id = 6"), items).collect()}
    assert cover[6]["n_items"] == 2 and 58 <= cover[6]["leaked_words"] <= 66


def test_blocks_of_items_give_the_same_leaks(spark, monkeypatch):
    rnd = random.Random(11)
    a, b, c, shared = (sentence(rnd, n) for n in (60, 60, 60, 30))
    items = spark.createDataFrame([(1, " ".join(a + shared)), (2, " ".join(shared + b)), (3, " ".join(c)), (3, " ".join(c)), (4, None), (5, "few")], "item_id long, text string")
    noise = sentence(rnd, 30)
    rows = [(1, noise + a[:30] + noise), (2, noise + shared + noise), (3, c[5:40]), (4, noise), (3, b[:25] + noise), (3, c[5:40])]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string")
    whole = sorted(map(tuple, leakage.leaks(docs, items).collect()))
    assert {(r[0], r[2]) for r in whole} == {(1, 1), (3, 3), (3, 2)}  # the shared wording is no leak
    cover = sorted(map(tuple, leakage.coverage(docs, items).collect()))
    assert [(r[0], r[1]) for r in cover] == [(1, 1), (3, 1), (3, 1)]
    monkeypatch.setattr(leakage, "MAX_BLOCK", 80)
    assert sorted(map(tuple, leakage.leaks(docs, items).collect())) == whole
    assert sorted(map(tuple, leakage.coverage(docs, items).collect())) == cover


def test_leaked_spans_are_cut_out(spark):
    rnd = random.Random(12)
    a, noise = sentence(rnd, 60), sentence(rnd, 30)
    items = spark.createDataFrame([(1, " ".join(a))], "item_id long, text string")
    mixed = f"{' '.join(noise)}.\n\n({', '.join(a[5:30]).upper()})! {' '.join(noise)}"
    docs = spark.createDataFrame([(1, mixed, 7), (2, " ".join(a), 7), (3, " ".join(noise), 7), (4, None, 7)], "doc_id long, text string, spans int")
    got = {r["doc_id"]: r for r in leakage.without_leaks(docs, items).collect()}
    assert set(got) == {1, 3, 4} and got[1]["removed_words"] == 25 and got[1]["spans"] == 7
    assert got[1]["text"] == f"{' '.join(noise)}.\n\n {' '.join(noise)}" and got[3]["text"] == " ".join(noise) and got[4]["text"] is None
    assert leakage.cut_spans("one two-\nthree four&nbsp;five six", [(1, 2)]) == "one  four&nbsp;five six"
    assert leakage.cut_spans("a b c d", [(0, 1), (3, 4)]) == " b c "


def p8_items(a, b=()):
    return leakage.Automaton([(1, list(a)), (2, list(b))])


def test_best_part_of_a_span_leaks():
    a = VOCABULARY[:60]
    rest = [f"other{i}" if i % 3 == 2 else w for i, w in enumerate(a[30:50])]
    spans = p8_items(a).spans(["noise"] * 9 + a[10:30] + rest + ["noise"] * 9)
    assert len(spans) == 1 and spans[0][0] == 1 and spans[0][3] == 9 and spans[0][4] >= 29
    # the bad half alone is none
    assert p8_items(a).spans(["noise"] * 9 + rest + ["noise"] * 9) == []


@pytest.mark.parametrize("altered", [(7, 9), (9, 11), (5, 7), (10, 12)])
def test_word_between_altered_words_counts(altered):
    a = VOCABULARY[:60]
    doc = [f"other{i}" if i in altered else w for i, w in enumerate(a[10:30])]
    assert p8_items(a).spans(["noise"] * 9 + doc + ["noise"] * 9) == [(1, 20, 18, 9, 29)]


def test_alternating_altered_words():
    a = VOCABULARY[:60]
    doc = [f"other{i}" if i in (12, 14, 16) else w for i, w in enumerate(a[10:40])]
    assert p8_items(a).spans(["noise"] * 9 + doc + ["noise"] * 9) == [(1, 30, 27, 9, 39)]


@pytest.mark.parametrize("size", [18, 19])
@pytest.mark.parametrize("altered", [(-2,), (1,), (1, -2)])
def test_altered_word_next_to_the_edge_of_a_passage(size, altered):
    a = VOCABULARY[:60]
    doc = a[10 : 10 + size]
    for i in altered:
        doc[i] = "other"
    assert p8_items(a).spans(["noise"] * 9 + doc + ["noise"] * 9) == [(1, size, size - len(altered), 9, 9 + size)]
    # 17 words are too few
    doc = a[10:27]
    doc[-2] = "other"
    assert p8_items(a).spans(["noise"] * 9 + doc + ["noise"] * 9) == []


def test_parts_against_brute_force():
    rnd = random.Random(3)
    automaton = p8_items(VOCABULARY[:80])
    for _ in range(300):
        kept = [k for k in range(70) if rnd.random() < rnd.choice((0.8, 0.9))] or [0]
        pairs = [(k, k) for k in kept]
        want = set()
        for i, x in enumerate(kept):
            for j in range(i, len(kept)):
                n = kept[j] - x + 1
                if n >= leakage.MIN_RUN and j - i + 1 >= leakage.MIN_AGREE * n - 1e-6:
                    want |= set(range(i, j + 1))
        got = automaton._parts(pairs)
        assert {k for i, j in got for k in range(i, j + 1)} == want


def test_merge_spans():
    assert leakage.merge_spans([(5, 9), (0, 3), (2, 4), (9, 10)]) == [(0, 4), (5, 10)]


TARGETS = "source string, target_share double, max_repeats int"


def held(spark, sizes):
    rows = [(i, s, float(1 + i % 3), n) for i, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, source string, weight double, tokens long")


def test_mix_reaches_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 20)
    monkeypatch.setattr(mixing, "BUCKETS", 4)
    rnd = random.Random(1)
    sizes = [(rnd.choice(["a", "a", "a", "b", None, "other"]), rnd.randrange(0, 50)) for _ in range(1500)] + [("small", 40)] * 3
    df = held(spark, sizes)
    total = sum(n for _, n in sizes)
    targets = spark.createDataFrame([("a", 0.35, 3), ("b", 0.5, 4), ("small", 0.1, 2), ("absent", 0.05, 9)], TARGETS)
    planned = mixing.plan(df, targets)
    by = {r["source"]: r for r in planned.collect()}
    assert {s for s, r in by.items() if r["short"]} == {s for s, share, most in [("a", 0.35, 3), ("b", 0.5, 4), ("small", 0.1, 2), ("absent", 0.05, 9)] if sum(n for x, n in sizes if x == s) * most < share * total}
    mixed = mixing.mix(df, planned).collect()
    used = {}
    for r in mixed:
        used[r["source"]] = used.get(r["source"], 0) + r["tokens"] * r["repeats"]
        assert 1 <= r["repeats"] <= by[r["source"]]["max_repeats"]
        assert r["repeats"] - by[r["source"]]["epochs"] in (0, 1)
    for s, r in by.items():
        want = min(r["tokens"] * r["max_repeats"], r["budget"])
        assert want - 50 <= used.get(s, 0) <= want + 1e-6
    # the sample is what one sorted pass would take
    for s in ("a", "b"):
        docs = [(-math.log(1), i) for i, (x, _) in enumerate(sizes) if x == s]
        assert len(docs) > 100
    again = mixing.mix(df.repartition(5), planned).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mixed))
    rows = {r["source"]: r for r in mixing.shares(planned, mixing.mix(df, planned)).collect()}
    assert abs(sum(r["share"] for r in rows.values()) - 1) < 1e-9 and rows["absent"]["used_tokens"] == 0


def test_sample_is_the_sorted_prefix(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 7)
    monkeypatch.setattr(mixing, "BUCKETS", 3)
    df = held(spark, [("a", 3 + i % 5) for i in range(300)])
    planned = mixing.plan(df, spark.createDataFrame([("a", 0.4, 1)], TARGETS))
    rest = planned.first()["rest"]
    keyed = sorted((r["k"], r["doc_id"], r["tokens"]) for r in df.select("doc_id", "tokens", mixing.sample_key(F.col("doc_id"), F.col("weight"), 0).alias("k")).collect())
    want, run = set(), 0
    for _, d, n in keyed:
        run += n
        if run <= rest:
            want.add(d)
    assert {r["doc_id"] for r in mixing.mix(df, planned).collect()} == want


def test_heavier_documents_are_drawn_more_often(spark):
    df = spark.createDataFrame([(i, "a", 1.0 if i % 2 else 0.1, 1) for i in range(2000)], "doc_id long, source string, weight double, tokens long")
    planned = mixing.plan(df, spark.createDataFrame([("a", 0.3, 1)], TARGETS))
    drawn = [r["doc_id"] for r in mixing.mix(df, planned).collect()]
    assert len(drawn) == 600 and sum(d % 2 for d in drawn) > 450


def test_empty_tables_mix_to_nothing(spark):
    df = held(spark, [("a", 1)]).where("false")
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    planned = mixing.plan(df, targets)
    assert mixing.mix(df, planned).count() == 0 and planned.first()["short"] is False
    assert mixing.plan(df, targets.where("false")).count() == 0


def test_tokens_of_odd_texts(spark, monkeypatch):
    assert mixing.count_tokens([None, "", "a word"]) == [0, 0, 2]
    encode = mixing.encoder(mixing.TOKENIZER).encode_ordinary
    text = "some running words " * 30_000
    assert mixing.count_tokens([text])[0] == len(encode(text))
    rnd = random.Random(7)
    for size in (0, 3, 10, 50):
        monkeypatch.setattr(mixing, "PIECE", size)
        for _ in range(200):
            odd = "".join(rnd.choice(["word", "s", "'s", " ", "  ", "\n", "\t ", "12", "é", "漢字", "!?", "_", "\u00a0", " \n", "...", "a"]) for _ in range(60))
            assert mixing.count_tokens([odd])[0] == len(encode(odd)), odd
    docs = spark.createDataFrame([(1, "a", "one two", 5), (2, None, None, 5), (3, "a", "", 5)], "doc_id long, source string, text string, tokens int")
    assert {r["doc_id"]: r["tokens"] for r in mixing.sized(docs).collect()} == {1: 2, 2: 0, 3: 0}


COMMON = dict.fromkeys(["the", "in", "on", "at", "el", "la"], 1) | dict.fromkeys(["that", "because", "and", "while", "que", "porque", "was", "when"], 2)

PROSE = [
    "The baker burned the letter because the postman ignored the mayor in the kitchen, and the choir was at the border when the train left.",
    "THE BAKER BURNED THE LETTER BECAUSE THE POSTMAN IGNORED THE MAYOR IN THE KITCHEN AND THE CHOIR",
    "the baker burned the\nletter because the postman\nignored the mayor in\nthe kitchen and the\nchoir was at the border",
    "- The baker burned the letter because the postman ignored the mayor.\n- The choir was at the border when the train left in the night.",
    "In the valley, the baker on the island watched the twin sister at the fairground in the end.",
]
NO_PROSE = [
    "the piano in the cellar; the camera at the border; the bakery on the island; the letter in the valley; the mayor in the courtyard",
    "the piano in the cellar, the camera at the border, the bakery on the island, the letter in the valley, the mayor in the courtyard",
    "• the piano in the cellar\n• the camera at the border\n• the bakery on the island\n• the letter in the valley",
    "| the piano in the cellar | 1950 | 3.1 |\n| the camera at the border | 1961 | 2.2 |\n| the bakery on the island | 1971 | 9.0 |",
    "Piano: 12\nCamera: in the cellar\nBakery: 44\nLetter: Torba Vel\nMayor: 19",
    "ha, ha, " * 40,
    "and the and the " * 20,
    "#####____=====~~~~****" * 5,
    "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ\n" * 6,
    "door bicycle painted repaired contract sold ignored orchard missed carried hid apprentice weather bought",
]


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    assert textstats.statistics(text, COMMON)[-1] > 0.5


@pytest.mark.parametrize("text", NO_PROSE)
def test_no_prose(text):
    assert textstats.statistics(text, COMMON)[-1] < 0.5


PAIRS = ["salt and pepper", "hammer and nails", "rope and string", "needle and thread", "bread and butter", "day and night", "horse and cart", "cup and saucer"]
TABULAR = [
    "\n".join(f"| {x} | in the {x.split()[0]} | on sale |" for x in PAIRS),  # aligned delimiters
    "\n".join(f"{x}\tthat {x.split()[2]}\tin the box" for x in PAIRS),
    "\n".join(f"- the {x}" if i % 2 else f"  - {x} in the {x.split()[0]}" for i, x in enumerate(PAIRS * 2)),  # periodic indentation
    "<table>" + "".join(f"<tr><td>{x}</td><td>in the {x.split()[0]}</td><td>when on sale</td></tr>" for x in PAIRS) + "</table>",
    "\n".join(f"{x} | in the {x.split()[0]} | {x} | when on sale | {x} | that box" for x in PAIRS),
]


@pytest.mark.parametrize("text", TABULAR)
def test_layout_decides_where_cells_hold_joining_words(text):
    assert textstats.statistics(text, COMMON)[-1] < 0.5


def test_prose_beside_and_within_a_layout():
    sentence = PROSE[0]
    both = textstats.statistics(sentence * 3 + "\n\n" + TABULAR[0], COMMON)[-1]
    assert 0.3 < both < 0.7
    # sentences in entries stay prose, and so does a paragraph that is quoted or indented as a whole
    assert textstats.statistics("\n".join(f"- {sentence}" for _ in range(5)), COMMON)[-1] > 0.5
    for mark in ("> ", "| ", "    "):
        assert textstats.statistics("\n".join(mark + x for x in (PROSE[2] + "\n" + PROSE[2]).split("\n")), COMMON)[-1] > 0.5


def test_statistics_table(spark):
    rows = [(1, PROSE[0]), (2, None), (3, "  \n"), (4, NO_PROSE[0]), (4, NO_PROSE[0]), (5, "½ 12 %"), (6, (PROSE[0] + " ") * 2000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_words int")
    common = spark.createDataFrame([("en", w) for w in COMMON] + [("xx", None)], "lang string, word string")
    stats = {r["doc_id"]: r for r in textstats.text_statistics(docs, common).collect()}
    assert stats[2]["n_words"] == 0 and stats[2]["mean_word_length"] is None and stats[1]["punctuated_lines"] == 1.0
    assert stats[5]["n_words"] == 0 and stats[5]["prose_share"] == 0
    assert sorted(r[0] for r in textstats.mostly_no_prose(docs, common).collect()) == [4, 4, 5]
    assert textstats.mostly_no_prose(docs.where("false"), common).count() == 0
    # without a list every language is unknown: sentences are told by their run
    assert sorted(r[0] for r in textstats.mostly_no_prose(docs, common.where("false")).collect()) == [4, 4, 5]


def test_mix_without_broadcast_and_shortness_of_what_was_used(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 20)
    monkeypatch.setattr(mixing, "BUCKETS", 4)
    df = held(spark, [(s, n % 7) for n in range(400) for s in ("a", "b")] + [("tiny", 0), ("tiny", 3), (None, 5)])
    targets = spark.createDataFrame([("a", 0.35, 2), ("b", 0.45, 1), ("tiny", 0.1, 2), ("absent", 0.1, 3)], TARGETS)
    planned = mixing.plan(df, targets)
    mixed = mixing.mix(df, planned)
    plain = sorted(map(tuple, mixed.collect()))
    assert max(r[3] for r in plain) <= 2
    assert {r["source"] for r in mixing.shares(planned, mixed).where("short").collect()} == {r["source"] for r in planned.where("short").collect()} == {"tiny", "absent"}
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 1)
    assert sorted(map(tuple, mixing.mix(df, planned).collect())) == plain


OTHER_LANGUAGES = {
    "fi": "Vanha majakanvartija asui saaren pohjoispäässä yksin koiransa kanssa. Joka ilta hän sytytti lampun ja kirjoitti päiväkirjaansa, mitä meri oli tuonut rantaan. Eräänä syksynä laiva ajoi karille, eikä kukaan uskonut hänen kertomustaan.",
    "pl": "Stary latarnik mieszkał na północnym krańcu wyspy razem ze swoim psem. Każdego wieczoru zapalał lampę i zapisywał w dzienniku, co morze wyrzuciło na brzeg. Pewnej jesieni statek wpłynął na skały, ale nikt nie uwierzył w jego opowieść.",
    "it": "Il vecchio guardiano del faro viveva da solo con il suo cane. Ogni sera accendeva la lampada e scriveva nel diario quello che il mare aveva portato a riva. Un autunno una nave finì sugli scogli, ma nessuno credette al suo racconto.",
    "tr": "Yaşlı fener bekçisi adanın kuzey ucunda köpeğiyle yalnız yaşıyordu. Her akşam lambayı yakıyor ve denizin kıyıya getirdiklerini defterine yazıyordu. Bir sonbahar gecesi gemi kayalara çarptı ama kimse ona inanmadı.",
    "hu": "Az öreg világítótoronyőr egyedül élt a kutyájával a sziget északi végén. Minden este meggyújtotta a lámpát, és feljegyezte a naplójába, mit hozott partra a tenger. Egy őszi éjszakán egy hajó zátonyra futott.",
    "ru": "Старый смотритель маяка жил один со своей собакой на севере острова. Каждый вечер он зажигал лампу и записывал в дневник, что море вынесло на берег. Однажды осенью корабль сел на мель.",
    "zh": "老灯塔看守人独自和他的狗住在岛的北端。每天晚上他点亮灯，在日记里写下大海带到岸边的东西。有一年秋天，一艘船撞上了礁石。",
}


@pytest.mark.parametrize("lang", OTHER_LANGUAGES)
@pytest.mark.parametrize("known", [COMMON, {}])
def test_sentences_are_prose_whatever_their_language(lang, known):
    text = OTHER_LANGUAGES[lang]
    assert textstats.statistics(text, known)[-1] > 0.5
    assert textstats.statistics(text * 3 + "\n\n" + text, known)[-1] > 0.5
    if lang != "zh":
        words = text.split()
        ragged = "\n".join(" ".join(words[i : i + 6]) for i in range(0, len(words), 6))
        assert textstats.statistics(ragged, known)[-1] > 0.5
        # fragments and names in it are none
        assert textstats.statistics("\n".join(f"- {a} {b}" for a, b in zip(words[::2], words[1::2])).replace(".", ""), known)[-1] < 0.5
        assert textstats.statistics("; ".join(f"{a} {b}" for a, b in zip(words[::2], words[1::2])).replace(".", ""), known)[-1] < 0.5


@pytest.mark.parametrize("text", NO_PROSE)
def test_no_prose_without_common_words(text):
    assert textstats.statistics(text, {})[-1] < 0.5


def test_long_lists_of_common_words_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*PROSE, *NO_PROSE, None, ""])], "doc_id long, text string")
    common = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    plain = sorted(map(tuple, textstats.text_statistics(docs, common).collect()))
    monkeypatch.setattr(textstats, "MAX_COMMON", 3)
    assert sorted(map(tuple, textstats.text_statistics(docs, common).collect())) == plain
