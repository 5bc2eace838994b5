"""Ordinary sentences are not toxic, whatever beginnings the sample taught; repeated ids do not enlarge the sample."""

import pytest

from touchline.llm import toxicity
from touchline.llm.queries import table

LARGE = "/root/testdata/sf0.1"
PLAIN = """The distance to the lake is short.|We walked along the path in the morning.|Please translate this letter.|It is more than enough.|Close the window.|The clouds closed over the district.
A tradition of the mountain villages.|Students study the stupa near the station.|They displayed the pathway map.|The train travels through Morocco.|Idioms are hard to translate.|The clock tower is closed today.
Moral questions are discussed in class.|The lost letter was found.|Worth a visit, said the guide.|A transfer takes two days.|The patient recovered quickly.|Mortgage rates went down.|The disc is on the table.|Trade grew more than before.
Le train part à huit heures.|Nous marchons sur le chemin.|La distance est courte.|Il faut fermer la fenêtre.|Elle traduit une lettre.|Les cloches sonnent le matin.|Un district tranquille.|La mort du roi fut triste.|Le trajet dure deux heures.|Il discute avec sa mère.
Der Weg zum See ist kurz.|Wir gehen am Morgen spazieren.|Bitte übersetze den Brief.|Das ist mehr als genug.|Mach das Fenster zu.|Die Distanz beträgt zwei Meilen.|Das Idiom ist schwer.|Der Patient ist gesund.|Die Straße ist gesperrt.|Morgen kommt der Zug.
La distancia al lago es corta.|Caminamos por la mañana.|Traduce la carta, por favor.|Es más que suficiente.|Cierra la ventana.|El distrito está tranquilo.|El clima es bueno.|El paciente está mejor.|La tradición es antigua.|Morir de risa es un dicho."""


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(table(spark, LARGE, "documents"), table(spark, LARGE, "labels"))


def test_ordinary_sentences_are_not_toxic(spark, model):
    texts = [(i, x) for i, x in enumerate(PLAIN.replace("\n", "|").split("|"))]
    got = toxicity.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).where("predicted = 1").collect()
    assert len(texts) == 50 and [texts[r.doc_id] for r in got] == []
    assert all(len(s) >= toxicity.MIN_STEM for s in model.stems)


def test_narrowed_stems():
    pure = {"clo": 40, "clow": 40, "clown": 39, "clowns": 9, "mor": 30, "moro": 12, "moron": 12, "moroc": 5, "dis": 8, "badword": 20, "badwords": 6, "badwordy": 5, "badwo": 21, "badwor": 21}
    assert toxicity.narrowed(pure) == ("badword", "clown", "moroc", "moron")
    assert toxicity.narrowed({}) == () and toxicity.narrowed({"abc": 9}) == ()


def test_repeated_ids_are_one_row_of_the_sample(spark):
    base = [(i, "you are an idiot" if i % 2 else "a fine day by the lake") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    once = toxicity.fit(spark.createDataFrame(base, "doc_id long, text string"), labels)
    often = toxicity.fit(spark.createDataFrame(base + [base[1]] * 500, "doc_id long, text string"), labels)
    assert once.stems == often.stems and (once.strength == often.strength).all() and once.unmatched == often.unmatched
