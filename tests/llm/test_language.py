import pytest

from tallyfield.llm.language import HyperProfiles, document_languages, fit_profiles, judge, paragraphs, spelled


@pytest.fixture(scope="module")
def pairs(sf):
    import pandas as pd

    s = pd.read_parquet(f"{sf}/lang_samples.parquet")
    return list(zip(s.lang, s.text))


def test_labels():
    assert [spelled(x) for x in (" EN ", "en-US", "pt_BR", "Deu", "French", "nld", None, "", "??", "und", "English")] == ["en", "en", "pt", "de", "fr", "nl", None, None, None, None, "en"]


def test_paragraphs_between_blank_lines():
    assert paragraphs("\n \na\nb\r\n\r\n \r\nc\r\rd") == ["a\nb", "c", "d"]
    assert paragraphs(" \n ") == []


def test_held_out_accuracy(pairs):
    wrong = 0
    for k in range(3):
        model = HyperProfiles(2048).fit([p for i, p in enumerate(pairs) if i % 3 != k])
        held_out = [p for i, p in enumerate(pairs) if i % 3 == k]
        wrong += sum(found[0][1] != lang for found, (lang, _) in zip(judge(model, [t for _, t in held_out]), held_out))
    assert wrong <= 0.05 * len(pairs)


def test_documents(spark, pairs):
    model = HyperProfiles(2048).fit(pairs)
    by = {}
    for lang, t in pairs:
        by.setdefault(lang, []).append(t)
    mixed = " ".join(by["de"][:3]) + "\n\n123\n \n" + by["fr"][0]
    docs = [(1, by["en"][0], "xx", 0), (2, None, "en", 0), (3, "", None, 0), (4, "1 2 3 👍", None, 0), (5, mixed, "German", 0), (6, (by["it"][0] + " ") * 500, "ita", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, seg_no int")
    got = {(r.doc_id, r.seg_no): r for r in document_languages(df, "doc_id", "text", "lang", model).collect()}
    assert {k: v.lang_code for k, v in got.items()} == {(1, -1): "en", (1, 0): "en", (5, -1): "de", (5, 0): "de", (5, 2): "fr", (6, -1): "it", (6, 0): "it"}
    assert got[(5, -1)].mixed and got[(5, -1)].labelled == "de" and got[(1, -1)].labelled is None
    assert all(0 < r.confidence <= 1 for r in got.values())
    assert document_languages(df.where("false"), "doc_id", "text", "lang", model).count() == 0


def test_confidence_is_calibrated_on_held_out_pieces(pairs):
    import numpy as np

    model = HyperProfiles(2048).fit([p for i, p in enumerate(pairs) if i % 2]).calibrate([p for i, p in enumerate(pairs) if i % 4 == 0])
    pieces = [(lang, " ".join(t.split()[i : i + 3])) for k, (lang, t) in enumerate(pairs) if k % 4 == 2 for i in range(0, len(t.split()) - 2, 3)]
    found = [(x[0][1] == lang, x[0][3]) for x, (lang, _) in zip(judge(model, [t for _, t in pieces]), pieces) if x and x[0][1]]
    right, sure = np.array([f[0] for f in found]), np.array([f[1] for f in found])
    assert len(found) > 100 and abs(right.mean() - sure.mean()) < 0.08
    high = sure > 0.9
    assert right[high].mean() > 0.85 > right[~high].mean()


def test_other_languages_are_unknown(pairs):
    model = HyperProfiles().fit(pairs)
    foreign = ["Spelaren kom tillbaka efter en lång skada och gjorde två mål i den sista matchen innan laget åkte hem.", "Игрок вернулся после долгой травмы и забил два гола в последнем матче.", "Zawodnik wrócił po długiej kontuzji i zdobył dwa gole w ostatnim meczu zanim drużyna pojechała do domu."]
    assert [(x[0][1], x[0][3]) for x in judge(model, foreign)] == [(None, 0.0)] * 3


def test_prototypes_and_bundles(spark, pairs):
    import numpy as np

    model = HyperProfiles(512).fit(pairs)
    assert np.allclose(np.linalg.norm(model.prototypes, axis=1), 1, atol=1e-4)
    texts = [["wort", "a" * 90, "wort"], ["b"] * 700, []]
    by_hand = np.array([sum((model.bind(r).astype(float) for w in ws for r in model.runs(w)), np.zeros(512)) for ws in texts])
    assert np.array_equal(model.bundle(texts), by_hand)
    df = spark.createDataFrame([*pairs, (None, "x"), ("en", None), ("xx", "y"), *pairs[:9]], "lang string, text string")
    fitted = fit_profiles(df.repartition(3), "lang", "text", 512)
    assert fitted.codes == model.codes and np.allclose(fitted.prototypes, model.prototypes, atol=1e-4) and 1 < fitted.sharpness < 100
    assert fit_profiles(df.where("false"), "lang", "text").codes == []
