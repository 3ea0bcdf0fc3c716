import random

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import langid as L

SENTENCES = {
    "en": ["the engine was quiet and the seats are really good", "we drove this car for two years without any problem", "not sure why people complain about the brakes"],
    "es": ["el motor es muy silencioso y los asientos son buenos", "tenemos este coche desde hace dos años sin ningún problema", "no sé por qué la gente se queja de los frenos"],
    "pt": ["o motor é muito silencioso e os bancos são bons", "temos este carro há dois anos sem nenhum problema", "não sei por que as pessoas reclamam dos freios"],
    "de": ["der Motor ist sehr leise und die Sitze sind wirklich gut", "wir fahren dieses Auto seit zwei Jahren ohne Probleme", "ich weiß nicht warum sich alle über die Bremsen beschweren"],
    "fr": ["le moteur est très silencieux et les sièges sont bons", "nous avons cette voiture depuis deux ans sans problème", "je ne sais pas pourquoi les gens se plaignent des freins"],
    "ru": ["двигатель очень тихий и сиденья хорошие", "мы ездим на этой машине два года без проблем"],
    "ja": ["エンジンはとても静かでシートも良いです", "この車に二年乗っていますが問題はありません"],
    "tr": ["motor çok sessiz ve koltuklar gerçekten iyi", "bu arabayı iki yıldır sorunsuz kullanıyoruz"],
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    rows = [(s, lang) for lang, ss in SENTENCES.items() for s in ss for _ in range(40)]
    rows = [(t, lang if rng.random() > 0.1 else rng.choice(list(SENTENCES))) for t, lang in rows]  # a tenth is labelled wrong
    return L.fit(rows)


def test_single_and_mixed(model):
    for lang, ss in SENTENCES.items():
        for s in ss:
            for t in (s, s.upper(), s.replace("é", "e") + " 👍"):
                assert [x[0] for x in model.segments(t)] == [lang], t
    mixed = SENTENCES["en"][0] + ". " + SENTENCES["de"][1] + ". " + SENTENCES["en"][1]
    segs = model.segments(mixed)
    assert [x[0] for x in segs] == ["en", "de", "en"] and all(x[1] > 0.9 for x in segs)
    assert mixed[segs[1][2] : segs[1][3]].startswith("wir fahren")


def test_no_words(model):
    for t in ("", "👍👍", "100% 2021 > 2020", "@user_1 https://x.example/a", "!!!"):
        assert model.segments(t) == []


def test_filter_has_no_false_negatives():
    b = L.BitFilter(slots=1 << 12)
    b.add({f"g{i}": 1 << (i % 11) for i in range(300)})
    got = b.languages([f"g{i}" for i in range(300)])
    assert all(int(m) >> (i % 11) & 1 for i, m in enumerate(got))
    assert (b.false_rate() < 0.05).all()


def test_labels(spark):
    cases = {"EN": "en", "en-US": "en", "short_en_rule": "en", "pt-BR": "pt", "German": "de", "und": None, "??": None, "": None, None: None, "xx": None, "jpn": "ja"}
    for r in spark.createDataFrame([(k,) for k in cases], "l string").select("l", L.label_language(F.col("l")).alias("c")).collect():
        assert r.c == cases[r.l]


def test_found_rows(spark):
    en, de = SENTENCES["en"], SENTENCES["de"]
    texts = [(f"c{i}", en[i % 3]) for i in range(30)] + [(f"d{i}", de[i % 3]) for i in range(30)] + [("m", en[0] + ". " + de[0]), ("e", "👍"), ("n", None), (None, en[0]), ("c0", en[0]), ("w", de[1])]
    labels = [(f"c{i}", "en") for i in range(1, 30)] + [(f"d{i}", "German") for i in range(30)] + [("m", "en"), ("w", "eng"), ("e", None)]
    df = spark.createDataFrame([(k, t, "x") for k, t in texts], "comment_id string, text string, k string")
    lab = spark.createDataFrame([(k, v, s) for k, v in labels for s in ("a", "b")], "id string, language string, scope string")
    got = sorted((r.comment_id, r.segment_no, r.lang_code) for r in L.wrong_labels(L.document_languages(df, lab)).collect())
    assert got == [("c0", 1, "en"), ("m", 1, "en"), ("m", 2, "de"), ("w", 1, "de")]
    assert L.document_languages(df.limit(0), lab.limit(0)).count() == 0
