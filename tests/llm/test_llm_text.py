"""Sentences, broken pairs and cut texts on written cases."""

import json
import random

import pytest

from quillon.llm import cuts, queries
from quillon.llm.endings import TOKEN, Endings, core, tokens
from quillon.llm.pairs import SuffixAutomaton, broken_pairs, copies, defect_of, refuses, texts_of, voted
from quillon.llm.sentences import Learnt, _item, _Levels, learn, sentences, split_sentences, task_sentences

SPLIT = [
    "He was held from 6.30 a.m. to 9.15 p.m. without food.| Mr. Ash and Dr. B. Oak (see p. 3. of it) relied on no. 12/05, vol. II, pp. 3-4.| 94 witnesses were heard.",
    "The answer of the panel was no.| 101 witnesses were heard.| The answer was no.| On it goes.",
    "General principles|\nThe first applicant\nwas heard by\nthe Court.|\n\n(b) Application to the present case|\n\nIt was so.",
    "A. Alleged violation of Article 8|\nThe Court agreed.|Section 4.7 of the Code applied.[4]| Next one.",
    "The judge replied: “There is no doubt. It stands! Why wait?” and left.| He asked, “Why me?”| The three (Was it? Was it not?) overlap.|\n“Nobody asked. Nobody answered.”| They left.",
    "Le juge répondit : « Il n'y a rien. Pourquoi ? » et leva la séance.| L'audience débuta à 9 h. 30 et prit fin à 17 h.| Elle a produit deux lettres, etc.| Une autre.",
    "Der 3. Senat hat am 9. März 2009 entschieden.| Z. B. hat Dr. Ode (vgl. Bd. II, S. 3 ff.) zugestimmt.| Er sagte: „Gut. Ja!“ und ging.",
    "В 1995 г. сумма в 94,5 тыс. руб. была выплачена г-ну А. Б. Велесову.| Судья ответил: «Нет. Зачем ждать?» — и ушёл.",
    "申请人（见第154.5段。）没有得到答复。|法官答道：“没有疑问。为什么要等？”随后休庭。|“没有人回答。什么也没说。”|赔偿额为31.5万元！",
    "一般原則|\n裁判官は「疑いはない。なぜ待つのか？」と答えて閉廷した。|では、どうか？",
    "ในปี 2017 รัฐบาลยอมรับต่าง ๆ แล้ว| ศาลย้ำว่ามาตรา 10 แห่งอนุสัญญา",
    "بلغ التعويض 36.5 في المائة.| هل كان صحيحا؟| قال القاضي: «لا شك. لماذا؟» ثم رفع الجلسة.",
    "डॉ. वर्णिक ने पृ. 93 पर लिखा।| क्या यह था?| न्यायाधीश ने कहा: “नहीं। क्यों?” और गए।",
    "See www.forms.court.example/eng?id=6 on it.| Lit. b) too.| An unmatched ( bracket stays.| Done.",
]


LINES = Learnt(lines=frozenset({"general principles", "application to the present case", "一般原則"}))


@pytest.mark.parametrize("case", SPLIT)
def test_sentences(case):
    text = case.replace("|", "")
    assert [text[s:e] for s, e in sentences(text, LINES)] == [x.strip() for x in case.split("|")]


# texts that have nothing to do with the tables
UNSEEN = [
    "Gen. Smith served at Ft. Knox.| He retired in May.", "Acme Bros. Ltd. in Paris was sold.| Nobody minded.", "See Eq. 4 and Thm. 5.| They follow at once.", "Vid. pág. 5 del Sr. López.| No hay más.",
    "Das gilt usw. und ggf. Herr Müller.| Er kam bzw. Frau Ode ging.", "Prof. Lee weighed 12 kg.| She ran 5 km. Then she slept.".replace("km. Then", "km.| Then"), "Dr. Hrsg. Bd. 2 ist da.| Es regnet.", "Gov. Hale met Sen. Pike vs. Rep. Dunn.| All agreed.",
    "See No. 4, Vol. 2, Fig. 3.| The end.", "Mme. Roux et Mlle. Petit sont là.| Elles rient.", "El Dr. Gil y la Dra. Paz, cf. pág. 9, vinieron.| Se fueron.", "Il sig. e la prof. Neri, cfr. p. 4.| Finito.", "Она живёт на ул. Мира.| Он ушёл.",
]


@pytest.mark.parametrize("case", UNSEEN)
def test_sentences_of_other_texts(case):
    text = case.replace("|", "")
    assert [text[s:e] for s, e in sentences(text)] == [x.strip() for x in case.split("|")]


def test_list_levels():
    assert [_item(x) for x in ("II. The law", "b) it", "(iv) x", "3.2. On", "12. x", "二十、x", "Word x")] == [("I.", 2), ("a)", 98), ("i)", 4), ("1.1", 2), ("1.0", 12), ("一", 12), None]
    levels = _Levels()
    assert not levels.enter("A.", 65)
    levels.stack[-1][2] = True  # it was a heading
    assert not levels.enter("1.0", 1) and not levels.enter("1.0", 2)
    assert levels.enter("A.", 66) and levels.stack == [["A.", 66, False]]  # the level within is closed
    text = "A. Alleged violation\nThe Court agreed.\n\n1. It was so.\n\nB. Costs, expenses\nThey were paid."
    assert [text[s:e] for s, e in sentences(text)] == ["A. Alleged violation", "The Court agreed.", "1. It was so.", "B. Costs, expenses", "They were paid."]


def test_words_and_lines_are_learnt(spark):
    texts = [f"{'Zwfl' if i % 2 else 'Heading word'}\nIt was xyzo. {i} and abco. so in the end.\n\nThe end {i}\nis near. Xyzo. 5 it was." for i in range(30)]
    got = learn(spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string"), "t")
    assert {"xyzo", "abco"} <= got.words and "near" not in got.words and "end" not in got.words
    assert {"zwfl", "heading word"} <= got.lines and not any(x.startswith("the end") for x in got.lines)
    assert learn(spark.createDataFrame([], "t string"), "t") == Learnt()


def test_what_is_learnt_beyond_the_most_frequent_is_used(spark, monkeypatch):
    """More words and lines than are sent to all tasks: rarer ones count as well."""
    texts = [f"{h}\nIt was {w}o. {i} and so on.¹{w}u. 5 it was.\n\n1. {h} of {w}\nThe end {i} is near." for i in range(25) for h, w in (("Zwfl qu", "xyz"), ("Heading word", "abc"), ("Ünder*", "klm"))]
    df = spark.createDataFrame([*enumerate(texts), (998, None), (999, texts[0])], "id long, t string")
    whole = learn(df, "t")
    want = sorted((i, s, e) for i, t in [*enumerate(texts), (999, texts[0])] for s, e in sentences(t, whole))
    assert len(whole.words) == 8 and len(whole.lines) == 6 and want != sorted((i, s, e) for i, t in [*enumerate(texts), (999, texts[0])] for s, e in sentences(t))
    monkeypatch.setattr("quillon.llm.sentences.LEARNT", 1)
    assert sorted(tuple(r) for r in split_sentences(df, ["id"], "t").collect()) == want
    assert len(learn(df, "t").words) == 1 and learn(df, "t").rest.count() == len(whole.words) + len(whole.lines) - 2


def test_units_and_space_are_the_whole_text():
    rnd = random.Random(2)
    for _ in range(1500):
        text = "".join(rnd.choice(["The ", "a", "A. ", ". ", "! ", "“", "”", "(", ")", "\n", "\n\n", "ไทย ", "。", "1", "...", " no. ", "„", "«", "»", "[1]", "\xa0"]) for _ in range(rnd.randint(0, 40)))
        spans = sentences(text)
        left = list(text)
        last = 0
        for s, e in spans:
            assert last <= s < e and not text[s].isspace() and not text[e - 1].isspace()
            left[s:e] = " " * (e - s)
            last = e
        assert not "".join(left).strip()


def test_split_tables(spark):
    df = spark.createDataFrame([("g", 1, None, 0), ("g", 1, "Ab ced. Ef gh.", 1), ("g", 1, " ", 2), ("g", 2, "", 0), (None, 3, "x", 0), ("g", 4, "x. Y." * 20_000, None)], "guide_id string, paragraph_id int, paragraph_text string, attempt int").selectExpr("*", "1 AS k0", "2 AS text")
    rows = task_sentences(df.drop("text")).collect()
    assert sorted(tuple(r) for r in rows if r["paragraph_id"] == 1) == [("g", 1, 0, 7), ("g", 1, 8, 14)]
    assert {r["paragraph_id"] for r in rows} == {1, 4}
    assert split_sentences(df.limit(0), ["guide_id"], "paragraph_text").count() == 0


Q = "Under what conditions can the search of the premises be justified under Article 8 in a case like application no. 1000001/12?"


def facts(*texts):
    return json.dumps([{"text": t, "citations": []} for t in texts])


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (None, "empty"), ("", "empty"), ("null", "empty"), ("[]", "empty"), (facts("N/A", "-", "​"), "empty"), ('"[]"', "empty"), (facts("It was so.")[:-4], "truncated"), (json.dumps(facts("It was so."))[:-9], "truncated"),
        (facts("Unfortunately, I am unable to give an answer to that. Please consult a lawyer."), "refusal"), (facts(f"The question asked was “{Q}”. I must decline to respond to this question."), "refusal"), (facts("The Court declined to answer the abstract question and examined the facts instead."), None),
        (facts("I cannot accept it, the applicant had written, and the domestic court treated this as an objection."), None), (facts(Q), "copied"), (facts("You ask: " + Q.lower()), "copied"), (facts(Q[:50], Q[50:]), "copied"), (facts(f"On the question “{Q}”: The search was lawful and had pursued a legitimate aim."), None),
        (facts("Yes, under Article 8."), None), (facts("No."), None), ("Six months.", None), (facts("Daraus folgt, dass die Ablehnung der Zeugen nicht notwendig war und die Familie belastete."), "language"), (facts("The applicant was heard. In the original: “Folglich ist der Artikel der Konvention verletzt worden.”"), None),
    ],
)
def test_defects(answer, want):
    assert defect_of(Q, answer, None) == want


def test_pairs_table(spark):
    rows = [("g", i, Q if i else None, a, "m", "x", 1) for i, a in enumerate([facts("It was so."), None, facts(Q), facts(Q)])]
    df = spark.createDataFrame([*rows, rows[2], (None, 9, Q, None, "m", "x", 1)], "guide_id string, group_id int, question string, answer string, grouping_method string, model_name string, pair int")
    assert sorted((r["group_id"], r["defect"]) for r in broken_pairs(df).collect()) == [(1, "empty"), (2, "copied"), (3, "copied")]
    assert broken_pairs(df.limit(0)).count() == 0


def test_suffix_automaton_against_search():
    rnd = random.Random(3)
    for _ in range(200):
        q, a = ([rnd.choice("abc") for _ in range(rnd.randint(1, 12))] for _ in range(2))
        inside = {tuple(q[i:j]) for i in range(len(q)) for j in range(i + 1, len(q) + 1)}
        want = [any(tuple(a[s:e]) in inside for s in range(i + 1) for e in range(i + 1, len(a) + 1) if e - s >= 2) for i in range(len(a))]
        assert SuffixAutomaton(q).covered(a, 2) == want


def test_parts():
    assert texts_of(json.dumps({"facts": [None, {"text": "a"}, {"text": {"text": "b"}}]})) == (["a", "b"], False)
    assert copies("a b c d", "x y z w") is False and refuses("It was so.") is False
    assert voted("Il s'ensuit que la mesure n'était pas nécessaire dans une société") == "fre" and voted("12") is None


WHOLE = "The Court noted that the measure had pursued a legitimate aim. The applicant was heard by the Regional Court in the end. It follows that the measure was necessary.\n\nKeywords: detention; fair hearing; costs"


def corpus():
    rnd = random.Random(7)
    s = ["The Court noted that the measure had pursued a legitimate aim.", "The applicant was heard by the Regional Court in the end.", "It follows that the search of the premises was necessary in a democratic society.", "There has accordingly been a violation of Article 8 of the Convention."]
    out = []
    for i in range(3000):
        text = " ".join(rnd.choice(s) for _ in range(rnd.randint(3, 20)))
        if i % 4 == 0:
            text += "\n\nKeywords: detention; fair hearing; costs"
        out.append((i, text[:500] if i % 3 == 0 else text, "short" if i % 3 == 0 else "long"))
    return out


def test_core_and_completeness():
    e = Endings.fit(t for _, t, _ in corpus())
    assert core("It was cut in the [...]") == "It was cut in the" and core("So it was.[5]</p>") == "So it was."
    for text in (WHOLE, "It was so.", "Was it?</p>\n", WHOLE.split("\n")[0] + "[3]"):
        assert e.complete(text) > 0.6, text
    for text in ("The Court noted that the", "The Court noted that the mea", "It was heard by the Regional…", "The applicant relied on Ash v.", "See (the", "The search of</p>"):
        assert e.complete(text) < 0.4, text


def test_cut_texts(spark):
    rows = corpus()
    df = spark.createDataFrame([*rows, (9001, None, "short"), (9002, " ", "short"), (9003, "", None)], "doc_id long, text string, source string").selectExpr("*", "1 AS id", "2 AS chars")
    got = {r["doc_id"]: r for r in cuts.cut_texts(df).collect()}
    assert len(got) == 3000
    wanted = {i for i, t, s in rows if len(t) == 500 and s == "short" and not t.endswith((".", "costs"))}
    found = {i for i, r in got.items() if r["cut"]}
    assert len(found & wanted) >= 0.97 * len(wanted) and len(found - wanted) <= 0.02 * len(wanted) + 3
    assert all(got[i]["at_limit"] for i in wanted)
    rates = {r["source"]: r for r in cuts.cut_rates(df).collect()}
    assert rates["short"]["n_texts"] == 1000 and rates["long"]["share"] < 0.02
    assert cuts.cut_texts(df.limit(0)).count() == 0


def test_copies_of_a_cut_text_do_not_teach_its_ending(spark):
    cut = WHOLE.split("\n")[0] + " The applicant had also asked the domestic authorities for a fresh medical examination"
    word = WHOLE.split("\n")[0] + " It follows that the applicant was heard by the Regional Cou"
    rows = [*corpus(), *((10_000 + i, t, "copied") for i, t in enumerate([cut, word] * 200))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert len(list(cuts.distinct_sample(df, "text"))) == len({t for _, t, _ in rows})
    alone = Endings.fit({t for _, t, _ in corpus()} | {cut, word})
    learnt = cuts.learn_endings(df, "text")
    assert learnt.complete(cut) == alone.complete(cut) < cuts.AT_LIMIT and learnt.complete(word) < cuts.ELSEWHERE
    # nor do texts that differ only at the beginning
    near = Endings.fit([t for _, t, _ in corpus()] + [f"{i}. {t}" for i in range(200) for t in (cut, word)])
    assert near.complete(cut) < cuts.AT_LIMIT and near.complete(word) < cuts.ELSEWHERE


def test_copies_of_a_cut_answer_do_not_teach_its_ending(spark):
    whole = [t for _, t, _ in corpus()][:400]
    cut = "The applicant was heard by the Regional Court in the end. The authorities had requested that the search"
    answers = [facts(a, b + ".") for a, b in zip(whole, whole[1:])] + [facts(f"{i}. It was so.", cut) for i in range(20)] + [facts(cut)] * 20
    rows = [("g", i, Q, a, "m", "x") for i, a in enumerate(answers)]
    df = spark.createDataFrame([*rows, *rows[-20:]], "guide_id string, group_id int, question string, answer string, grouping_method string, model_name string")
    found = {(r["group_id"], r["defect"]) for r in broken_pairs(df).collect()}
    assert {(i, "truncated") for i in range(len(answers) - 40, len(answers))} <= found and len(found) < 60


def letters(i):
    return "q" + "".join(chr(97 + i // 26**k % 26) for k in range(4)) + "z"


def test_endings_of_texts_are_learnt_from_all(spark, monkeypatch):
    """Many more texts than once were sampled, with words that stand in few of them: as if all had been learnt from on the driver."""
    rare = [(i, f"{i}. It was heard by the {letters(i % 20)}") for i in range(60)]
    rows = [*rare, *((100 + i, f"It was heard by the {letters(i)}{'.' * (i % 3 == 0)}") for i in range(20, 15_000)), *((20_000 + i, t) for i, t, _ in corpus()[:300]), (30_000, rare[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS source")
    alone = Endings.fit({t for _, t in rows})
    want = sorted((i, alone.complete(t)) for i, t in rows)
    assert sorted((r["id"], r["complete"]) for r in cuts.judged(df).collect()) == want and all(c > 0.5 for i, c in want if i < 60)
    monkeypatch.setattr("quillon.llm.corpus.ASKED", 6_000)  # in parts
    monkeypatch.setattr("quillon.llm.corpus.TOKENS", 5_000)
    assert sorted((r["id"], r["complete"]) for r in cuts.judged(df).collect()) == want


def test_endings_of_answers_are_learnt_from_all(spark):
    """Twenty words stand in three of many answers each: an answer that ends in one is whole."""
    answers = [facts(f"{i}. It was heard by the {letters(i % 20)}", "It was so.") for i in range(60)] + [facts(f"It was heard by the {letters(i)}", "It was so.") for i in range(20, 15_000)]
    asked = [facts("It was so.", f"It was heard by the {letters(i)}") for i in range(20)] + [facts("It was so.", "It was heard by the")]
    rows = [("g", i, None, a, "m", "x") for i, a in enumerate(asked + answers)]
    df = spark.createDataFrame(rows, "guide_id string, group_id int, question string, answer string, grouping_method string, model_name string")
    assert [(r["group_id"], r["defect"]) for r in broken_pairs(df).collect()] == [(20, "truncated")]


def test_tokens_of_chunks():
    rnd = random.Random(5)
    pieces = ["a", "é", "'", "’", "-", "1", "22", "\n", " ", "\n \n", "\t", "\xa0", "\x1c", "ก", "。", "漢字", ".", "́", "word", "\r"]
    for _ in range(5000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14)))
        assert tokens(text) == TOKEN.findall(text)
    assert core("It was so.") == "It was so." and core("It was so. Read more.") == "It was so." and core("It was...") == "It was"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_over_whole_tables(spark, name):
    """Each query gives rows of its columns, none of a found row null; exact neighbours are held against SQL."""
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in df.collect()]
    assert rows and len(set(df.columns)) == len(df.columns)
    if name.endswith("_found"):
        assert len(rows) == len(set(rows)) and not any(v is None for r in rows for v in r)
    if name == "p5_found":
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        con.execute("CREATE VIEW query_embeddings AS SELECT * FROM read_parquet('/root/testdata/sf0.001/query_embeddings.parquet')")
        assert set(rows) == set(con.execute(queries.oracle_sql()[name]).fetchall())
