import random

import pytest

from tallyframe.llm import pii as P

KNOWN = frozenset("oscar lorna priya gustav ximena hugo marlene imani pedro zoe karim dmitri dr jean maria ludwig david".split())
DET = P.Detector(given=KNOWN | frozenset(P.GIVEN))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail a.b+c@mail.example now", ["EMAIL"]),
        ("mail lorna_x (at) example dot com or kim[at]post.test", ["EMAIL", "EMAIL"]),
        ("oscar @ work.box.example, or tom at example dot org", ["EMAIL", "EMAIL"]),
        ("He posted it @ 9:30, paid 21,500 @ 3.9% thanks @fan_88", []),
        ("call (312) 555-0192 or +44 20 7946 0376", ["PHONE", "PHONE"]),
        ("ring 07700 900265, 001 312 555-0160, 713-555-0140 ext. 43, 8085550117", ["PHONE"] * 4),
        ("five five five, two one two, oh one nine nine", ["PHONE"]),
        ("３１２-555-0192", ["PHONE"]),
        ("Order 9912345678 since 2020-11-03. Part number 401-5512-90. Serial 88-1203-4471. Casting 3125550", []),
        ("my SSN 999-42-7624, DL# S25987351, PASSPORT NO. X72663176", ["ID_NUMBER"] * 3),
        ("DNI 48614755-G and tax ID 990-34-3042", ["ID_NUMBER", "ID_NUMBER"]),
        ("Updated part no. 912-44-1200 costs more. The VIN ends in 4471902. Case 20-4417-331 was opened", []),
        ("I live at 3345 COUNTY LINE AVE. and Birkenallee 95, 53871 Neuhask", ["ADDRESS", "ADDRESS"]),
        ("Flat 26, 161 Juniper Mews, Fennimore Falls", ["ADDRESS"]),
        ("9197 Saint Aldric St., Apt 21B, Kettle Bay, MN 70225", ["ADDRESS"]),
        ("to P.O. Box 3203, Marble Fork please", ["ADDRESS"]),
        ("The 330 Sport Drive mode. 2 Way mirrors. exit 14 on Route 9. I drive down Copperfield Street.", []),
        ("Ask for Priya Courou-Prabrook or Golick, Gustav", ["NAME", "NAME"]),
        ("THE CONTACT, XIMENA VILLSTRAND, STATED", ["NAME"]),
        ("my name is Dr. Hugo Pellulu", ["NAME"]),
        ("Marlene was right. Harrow Brothers Motors. Deleted User. Gustav and Imani", []),
        ("pedro randstrand", ["NAME"]),
        ("", []),
        ("bob (  at  ) mail (dot) com, bob at mail\ndot com, bob @\tmail.com", ["EMAIL"] * 3),
        ("122333 Main Street and 020 7946 0958, 01 23 45 67 89", ["ADDRESS", "PHONE", "PHONE"]),
        ("the part no." + " " * 90 + "312-555-0192", []),
        ("Maria de la Cruz met Ludwig van Beethoven, Jean-Pierre Dupont, John Thomas, David Martin and Maria Anna Kopp", ["NAME"] * 6),
        ("my neighbour Steven Qorvath, contact: Ueli Zgraggen, regards, Aoife Byrne", ["NAME"] * 3),
        ("ſsn 999-42-7624 and DRİVER LICENSE D4471902", ["ID_NUMBER"] * 2),
    ],
)
def test_types(text, want):
    assert [k for _, _, k in DET.find(text)] == want


def test_only_items_change():
    text = "Hi, Zoë Dorvello here ​— z.d (at) post dot test, (713) 555-0187! Bye"
    items = DET.find(text)
    assert P.redact(text, items) == "Hi, [NAME] here ​— [EMAIL], [PHONE]! Bye"
    long = ("nothing here " * 50000) + "a@b.example"
    assert [k for _, _, k in DET.find(long)] == ["EMAIL"]


def test_frames(spark):
    rows = [(1, "a@b.example and c@d.example", None, "x"), (2, None, "Karim Courulu", "x"), (3, "", "", "x"), (1, "a@b.example and c@d.example", None, "x")]
    df = spark.createDataFrame(rows, "row_id bigint, text string, author string, pii_type string")
    got = sorted((r.row_id, r.field_name, r.pii_type, r.nth) for r in P.find_pii(df, "row_id", ["text", "author"], name_columns=("author",)).collect())
    assert got == [(1, "text", "EMAIL", 1), (1, "text", "EMAIL", 1), (1, "text", "EMAIL", 2), (1, "text", "EMAIL", 2), (2, "author", "NAME", 1)]
    out = {r.row_id: (r.text, r.author) for r in P.redact_pii(df, "row_id", ["text", "author"], name_columns=("author",)).collect()}
    assert out == {1: ("[EMAIL] and [EMAIL]", None), 2: (None, "[NAME]"), 3: ("", "")}
    j = spark.createDataFrame([(1, '{"a": ["x@y.example"], "n": 3125550192, "b": {"c": "call 312-555-0192 or w@z.example"}}'), (2, "{broken x@y.example")], "row_id bigint, j string")
    got = sorted((r.row_id, r.pii_type, r.nth) for r in P.find_pii(j, "row_id", ["j"], ("j",)).collect())
    assert got == [(1, "EMAIL", 1), (1, "EMAIL", 2), (1, "PHONE", 1)]
    assert P.find_pii(df.limit(0), "row_id", ["text"]).count() == 0
    assert "and" in P.name_evidence(spark.createDataFrame([(f"this and that {i}",) for i in range(10)], "t string"), "t").common
    assert P.name_evidence(df.limit(0), "text", df.limit(0).select("author")) == P.NameWords()


def test_common_words_keep_family_names(spark):
    texts = ["mail dmitri.ostwick (at) mail (dot) com"] * 9 + ["my neighbour ostwick said so"] * 9 + [f"Ask Dmitri Ostwick about part {i}" for i in range(5)]
    texts += ["Ask Dmitri Ostwick for Dmitri Brakel"]
    texts += [f"write to ostwick{i}.brakel@mail.com, or brakel at mail dot com, see https://a.b/brakel/{i} and @brakel" for i in range(5)]
    fields = spark.createDataFrame([(f"Dmitri {x}",) for x in ("Ostwick", "Brakel", "Lund")], "a string")
    words = P.name_evidence(spark.createDataFrame([(t,) for t in texts], "t string"), "t", fields).common
    assert "about" in words and not words & {"ostwick", "brakel"}
    found = P.Detector(words, KNOWN).find("We met Dmitri Ostwick there")
    assert [k for *_, k in found] == ["NAME"]
    records = spark.createDataFrame([(f'{{"id": {i}, "text": "the pedal sank \\"low\\" again"}}',) for i in range(9)], "r string")
    assert "pedal" not in P.name_evidence(P.json_values(records, "r"), "text").common


def test_names_in_no_list(spark):
    """Given names are learned from the corpus alone; none of these is known from the start."""
    given = [f"{a}{b}" for a in ("Bel", "Dra", "Fio", "Hul", "Kes", "Mor", "Pav", "Tse") for b in ("dan", "rik", "mira", "lo", "neth")]
    family = [f"{a}{b}" for a in ("Ash", "Brun", "Cald", "Eng", "Holm", "Lind", "Stav", "Varn") for b in ("berg", "ford", "well", "sson", "ley", "quist")]
    rng = random.Random(3)
    fields = [f"{g} {f}" if rng.random() < 0.7 else f"{f}, {g}" for g in given for f in rng.sample(family, 4)] + ["Deleted User", "Kettle Bay Garage", "Torque Channel", None, ""]
    whole = [f"this is about the {rng.choice(['brake', 'wheel', 'door'])} and the Calder Alba number {i}" for i in range(300)]
    said = [(f"yesterday {g} {f} told us that the brake failed", f"{g} {f}") for g in given for f in rng.sample(family, 5)]
    plain = ["The Calder Alba was fine. Kettle Bay has a garage. Old Torque Channel videos"] * 3
    assert not {g.lower() for g in given} & set(P.GIVEN)
    texts = spark.createDataFrame([(t,) for t in whole + [t for t, _ in said] + plain], "t string")
    words = P.name_evidence(texts, "t", spark.createDataFrame([(x,) for x in fields], "a string"))
    det = P.Detector(words.common, words.given)
    hit = sum([t[a:b] for a, b, k in det.find(t) if k == "NAME"] == [name] for t, name in said)
    assert hit >= 0.98 * len(said)
    assert not any(k == "NAME" for t in whole + plain for *_, k in det.find(t))
    alone = P.Detector(words.common, frozenset())
    assert sum([k for *_, k in alone.find_name_field(x)] == ["NAME"] for x in fields if x) == 4 * len(given)


def test_skipped_patterns_find_nothing():
    """A pattern is left out only where it can't match: the same items with and without."""
    rng = random.Random(11)
    parts = ["bob", "(", "at", ")", "[dot]", "dot", "@", "mail", "com", "Mr.", "my name is", "Jane", "Roe", "Ms", "driver", "SSN", "s.s.n.", "DRIVER'S LICENSE", "Steuer-ID", "Führerschein", "reisepassnummer", "licence no.", "P.O. Box", "POBOX", "Postfach", "boîte postale"]
    parts += ["12", "4411", "999-42-7624", "312 555 0192", "Birkenweg 5", "Hauptstr. 7", "Main", "St", "Ave.", "rue de Lille", "12, rue", "calle Mayor 3", "five five five two one two nine", "contact", "ask for", "attn", "Priya", "Brown", "\n", "  ", ",", "I'm", "ſt", "K street", "chez M. Dupré"]
    fast, slow = P.Detector(given=KNOWN), P.Detector(given=KNOWN, skip=False)
    for _ in range(3000):
        t = rng.choice([" ", " ", "  ", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        t = rng.choice([str, str.upper, str.lower])(t)
        assert fast.find(t) == slow.find(t), t
