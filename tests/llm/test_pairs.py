import pytest

from pyspark.sql import functions as F

from quillspark.llm import tongues
from quillspark.llm.pairs import _judged, defective_pairs, judge, length_limits, masked, units_of

SCHEMA = "id bigint, original_query string, normalized_query string, generated_answer string, error string, generator_model string, unit string, defect string"

TEXTS = {
    "en": "The fee is Rs. 500 and it is collected every month. The warden waives the charge when members apply together. A request for the room goes through the portal and needs an address proof. It is Rs. 500 per day. If the branch is closed, the help desk decides, so the amount remains payable. Sorry for the delay in your case, which is refunded.",
    "hi-en": "Sirf naye members hi plan mein jud sakte hain. Customers ko fee har mahine deni hoti hai aur scheme ke liye address proof zaroori hai. Room ke liye portal par request karein.",
    "de": "Die Gebühr beträgt 500 Euro und wird monatlich fällig. Der Antrag wird über das Portal gestellt und benötigt einen Nachweis. Wenn die Filiale geschlossen ist, entscheidet die Zentrale jährlich.",
    "fr": "Les frais sont prélevés chaque mois. La demande passe par le portail et le dépôt est remboursé après le délai de grâce.",
}
MODEL = tongues.learn([(t, lang) for lang, t in TEXTS.items()])


def test_languages_by_characters(spark):
    for text, lang in ((TEXTS["en"], True), ("The warden collects the charge for the room.", True), ("Der Nachweis wird jährlich benötigt.", False), ("Naye customers ke liye fee zaroori hai.", False), ("El plazo de la devolución es de 5 días hábiles.", False)):
        assert (MODEL.english_margin(tongues.words_of(text)) > 0) == lang, text
    assert MODEL.english_margin([]) == 0 == tongues.learn([]).english_margin(["la"])
    assert tongues.words_of("the Tara Max plan AB-12 isn’t new") == ["the", "plan", "isn't", "new"]
    rows = [(i, t * (1 if i % 2 else 900), lang, "x") for i, (lang, t) in enumerate(list(TEXTS.items()) * 3)] + [(90, None, "en", "x"), (91, "x", None, "x"), (None, "y", "fr", "x")]
    fitted = tongues.sampled(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, h string"), sample=2)
    assert set(fitted.names) <= {*TEXTS, "*"} and all(c.total() <= 4 * tongues.SAMPLE_WORDS + 100 for c in fitted.words)
    assert tongues.sampled(spark.createDataFrame([], "doc_id bigint, text string, lang string")).english_margin(["a"]) == 0


@pytest.mark.parametrize(
    ("answer", "error", "defect"),
    [
        (None, None, "empty"), ("  \n​", None, "empty"), ("N/A", None, "empty"), ("(none)", "x", "empty"), ("No.", None, None), ("Rs. 500 per day", None, None),
        ("Error code: 503 - overloaded", None, "error_text"), ("An exception occurred: ReadTimeout: no reply", None, "error_text"), ("Disk quota gone on node 7", "Disk quota gone on node 7", "error_text"),
        ("The fee is Rs. 5.", "warning: retried 3 times", None), ("How much is the fee?", None, "copied_question"), ("Question: how much is the fee", None, "copied_question"),
        ("How much is the fee? The fee is Rs. 5.", None, None), ("I'm sorry, but I can't help with that.", None, "refusal"), ("The passages given to me say nothing about fees.", None, "refusal"),
        ("The warden is unable to waive the fee, so Rs. 5 remains payable.", None, None), ("If the help desk cannot answer your question, the branch decides.", None, None),
        ("Sorry for the delay in your case: the fee of Rs. 5 is refunded.", None, None), ("बचत खाता का शुल्क 5 रुपये है।", None, "other_language"), ("Sirf naye customers hi scheme mein jud sakte hain.", None, "other_language"),
        ("Die Gebühr beträgt 5 € und wird jährlich fällig.", None, "other_language"), ('The notice says "கட்டணம் இல்லை", which means no fee is taken.', None, None),
    ],
)
def test_single_rows(answer, error, defect):
    assert judge("How much is the fee?", None, answer, error, MODEL)[0] == defect


def test_units_and_masks():
    assert units_of("Pay Rs. 5 now. Then wait.\n1. Open it.\n2. Close it") == ["Pay Rs. 5 now.", "Then wait.", "1. Open it.\n2. Close it"]
    assert masked("The fee of Luma Max is Rs. 2,500.") == masked("The fee of Veda Lite is Rs. 9,125.") == "The fee of @ is rs 9,999"


def test_truncation_by_neighbours(spark):
    whole = [f"Contact the warden in {p} with reference AB-{n}." for p in ("Oldtown", "Newtown", "Midtown") for n in (1234, 5678)]
    whole += [f"The fee is Rs. {n},000" + ("." if n % 2 else "") for n in range(1, 9)]
    lists = [f"- a slip\n- a form\n- a fee of Rs. {n}" for n in (100, 200, 300, 400)]
    cut = ["Contact the warden in", "Contact the warden in Oldtown with refer", "The fee is", "- a slip\n- a fo", "Wait for the letter and …", "Bring the slip,", "Go to Oldt", "The fee is Rs. 3,000 (see the"]
    rows = [(i, "q?", None, a, None, "g", None, None) for i, a in enumerate(whole + lists + cut + [None])]
    rows.append(rows[-1])
    found = {r.id: r.defect for r in defective_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    n = len(whole) + len(lists)
    assert found == {n + k: "truncated" for k in range(len(cut))} | {n + len(cut): "empty"}


def test_empty_and_long(spark):
    assert defective_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "The fee is Rs. 5. " * 20_000
    assert defective_pairs(spark.createDataFrame([(1, None, None, long, None, None, None, None)], SCHEMA)).count() == 0


def test_terse_answers_whatever_their_number(spark):
    whole = [f"The {x} of day scholars and {y} is kept by the warden in {z}." for x in ("fee", "card", "slip") for y in ("minors", "traders", "guests") for z in ("Oldtown", "Newtown")]
    whole += ["Not for guests.", "This is for minors.", "Cards are for day scholars."]
    for copies in (1, 2, 3, 9):
        terse = ["Not applicable to day scholars", "Yes"] * copies
        broken = ["The fee of day scholars and minors is kept by", "The slip of day scholars and traders is"] * copies
        rows = [(i, "q?", None, a, None, "g", None, None) for i, a in enumerate(whole + terse + broken)]
        found = {r.id for r in defective_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert found == set(range(len(whole) + len(terse), len(rows))), copies


def test_limits_at_any_length(spark):
    words = "the warden keeps the card of the guest and the slip for the room in the office near the gate until the letter of the month has come and the desk has seen it".split()
    texts = [" ".join(words[k % 7 :] + words[: k % 7])[:100] + "." for k in range(30)]
    at_limit = [(" ".join(words[k % 11 :] * 3))[:200] for k in range(80)]
    longer = ["The warden keeps " + " ".join(words) + " " + " ".join(words) + "."]
    judged = lambda some: spark.createDataFrame([(i, "g", None, None, a, None) for i, a in enumerate(some)], "id bigint, generator string, p string, q string, a string, e string").mapInPandas(lambda b: _judged(b, None), ROW)
    ROW = "id bigint, generator string, defect string, size int, cut_look boolean, unit string, dangling boolean, whole array<string>, names array<string>"  # noqa: N806
    for some in (at_limit, at_limit + longer, texts + at_limit + longer * 5):
        assert [tuple(r) for r in length_limits(judged(some)).collect()] == [("g", 200)]
    assert length_limits(judged(texts + ["Rs. 5,125 per day"] * 60 + longer * 400)).count() == 0
    reasons = defective_pairs(spark.createDataFrame([(i, "q", None, a, None, "g", None, None) for i, a in enumerate(at_limit)], SCHEMA), with_reason=True)
    assert reasons.filter(F.col("why").isNull()).count() == 0 and reasons.count() > 70
