from pyspark.sql import functions as F

from folioframe.functions import scoring as sc
from folioframe.functions import text as tx
from folioframe.operators import corrections as co

L = F.lit


def test_match_score_grades(one):
    text = "Протокол испытаний бетона на участке"
    score = lambda q, t=text: one(sc.match_score(L(q), L(t)))
    assert score("Протокол испытаний") == 1.0
    assert score("протокол испытаний") == 0.93
    assert score("участке Протокол") == 0.88
    assert abs(score("участке протокол") - 0.83) < 1e-9
    assert abs(score("участке кран") - (0.28 + 0.24 * 0.5)) < 1e-9
    assert abs(score("кран люк") - 0.28) < 1e-9
    assert score("кран") == 0.0
    assert score("", text) == 0.0 and score("кран", "") == 0.0


def test_match_score_folds_yo_as_lemma(one):
    assert one(sc.match_score(L("берёза липа"), L("липа и береза"))) == 0.80
    assert abs(one(sc.match_score(L("берёза"), L("береза у дома"))) - 0.72) < 1e-9


def test_drawing_mark_rules(one):
    score = lambda t: one(sc.match_score(L("ограждение №1"), L(t)))
    assert score("Ограждение Ог-1/ перекос стойки/") == 1.0
    assert score("ограждение ог-1/замечаний нет/") == 0.85
    assert score("лист ог-1/2") == 0.96


def test_intents(one):
    intent = lambda q: one(tx.query_intent(L(q)))
    assert intent("Открой документ") == "open"
    assert intent("открой и опиши") == "summarize"
    assert intent("ПРОАНАЛИЗИРУЙ письмо") == "analyze"
    assert intent("краткое содержание") == "summarize"
    assert intent("какая марка бетона") == "qa"


def test_normalize_query(one):
    norm = lambda q: one(tx.normalize_query(L(q)))
    assert norm("ростех   надзор") == "ростехнадзор"
    assert norm("ОПО класс") == "опасный производственный объект класс"
    assert norm("ограждение 1") == "ограждение 1 Ограждение Ог-1"
    assert norm("люки №7") == "люки №7 Л-7"
    assert norm("акт проминвест") == "акт проминвест nponisusecr nponinvest"


def test_doc_number(one):
    has = lambda n, d: one(tx.has_doc_number(L(n), L(d)))
    assert has("Документ о качестве №452.pdf", "452")
    assert has("акт 452_1.pdf", "452")
    assert not has("акт 14525.pdf", "452")
    assert one(tx.doc_number_score(L("№452 от 2024"), F.array(L("452")))) == 60


def test_quality(one):
    q = lambda t: one(tx.text_quality(L(t)))
    assert q("") == 0.0
    assert q("коротко") == 0.15
    assert q("12.5 13.7 14.1 15.9 16.0 17.7") == 0.05
    assert q("Требования к производству работ на участке строительства") > 0.9


def test_parse_analysis(one):
    text = "СУТЬ: Письмо о сроках.\nГЛАВНОЕ:\n- срок\n2) сумма\n\nТИП: письмо."
    a = one(tx.parse_analysis(L(text)))
    assert (a["gist"], a["key_points"], a["doc_type"]) == ("Письмо о сроках.", ["срок", "сумма"], "письмо")
    b = one(tx.parse_analysis(L("первая\n- вторая\n* третья")))
    assert (b["gist"], b["key_points"], b["doc_type"]) == ("первая", ["вторая", "третья"], "прочее")


def test_qa_pairs(one):
    tagged = one(tx.qa_pairs(L("[Q]: один?\n[A]: раз\nещё\n[q] : два? [a]: два")))
    assert [(p["question"], p["answer"]) for p in tagged] == [("один?", "раз\nещё"), ("два?", "два")]
    js = one(tx.qa_pairs(L('```json\n[{"question": "x", "answer": " y "}, {"question": "", "answer": "z"}]\n```')))
    assert [(p["question"], p["answer"]) for p in js] == [("x", "y")]
    assert one(tx.qa_pairs(L("ничего"))) == []


def test_corrections_and_todo(one):
    assert one(tx.user_correction(L("Неправильно: срок 5 дней."))) == "срок 5 дней"
    assert one(tx.user_correction(L("нет, десять"))) == "десять"
    assert one(tx.user_correction(L("а почему?"))) is None
    assert one(tx.is_no_answer(L("Информации НЕТ в архиве")))
    assert one(tx.todo_items(L("Нужно: купить\nпросто\ntodo сдать"))) == ["купить", "сдать"]


def test_follow_up(one):
    assert one(tx.is_follow_up(L("подробнее про второй пункт")))
    assert one(tx.is_follow_up(L("ок")))
    assert not one(tx.is_follow_up(L("Какой срок поставки по договору номер 12345 с заводом?")))


def test_speech_and_mojibake(one):
    assert one(tx.fix_speech(L("гурнал  работ"))) == "журнал работ"
    assert one(tx.fix_speech(L("найди птн"))) == "найди ТТН"
    broken = "Журнал".encode().decode("cp1251", "ignore")
    assert "Журнал".encode().decode("cp1251") == broken
    assert one(co.repair_mojibake(L(broken))) == "Журнал"


def test_redaction(one):
    out = one(tx.redact(L("пишите a.b@example.org, +7 912 345-67-89, Bearer abcdefgh12")))
    assert out == "пишите [REDACTED_EMAIL], [REDACTED_PHONE], [REDACTED_TOKEN]"


def test_suffix_and_path(one):
    assert one(tx.suffix(L("a/b.tar.GZ"))) == ".gz"
    assert one(tx.suffix(L("a/.hidden"))) == ""
    assert one(sc.path_score(L("акт 12"), L("архив/Акт 12.pdf"))) == 8.0
    assert one(sc.path_score(L("Акт 12"), L("архив/Акт 12.pdf"))) == 10.0
