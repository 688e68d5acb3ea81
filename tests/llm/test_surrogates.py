import re

import pytest

from quillgraph.llm import surrogates as S

TEXT = """Mail best.54@mail3.example.com or BEST.54@mail3.example.com, call +1 (743) 555-3824 / 743-555-3824, host 152.143.123.131 not 999.1.1.1 or 1.2.3.4.5,
card 4111 1111 1111 1111 (4111111111111111, not 4111111111111112), ssn 123-45-6789, DE89 3704 0044 0532 0130 00. Mrs. Anna Schmidt met Mr. Jones; Frau Schmidt-Meier, г-н Иванов."""


def test_find():
    got = [(TEXT[a:b], k) for a, b, k, _ in S.find(TEXT)]
    assert got == [
        ("best.54@mail3.example.com", "email"), ("BEST.54@mail3.example.com", "email"), ("+1 (743) 555-3824", "phone"), ("743-555-3824", "phone"), ("152.143.123.131", "ip"),
        ("4111 1111 1111 1111", "card"), ("4111111111111111", "card"), ("123-45-6789", "ssn"), ("DE89 3704 0044 0532 0130 00", "account"),
        ("Anna Schmidt", "name"), ("Jones", "name"), ("Schmidt-Meier", "name"), ("Иванов", "name"),
    ]


@pytest.mark.parametrize(("text", "want"), [
    ("card 4111 1111 1111 1111 123 end", ["4111 1111 1111 1111"]),
    ("card 4111111111111111 12/25", ["4111111111111111"]),
    ("4111111111111111 4 times", ["4111111111111111"]),
    ("order 12 4111 1111 1111 1111 12/25", ["4111 1111 1111 1111"]),
    ("2 cards 4111-1111-1111-1111 5500-0000-0000-0004 99", ["4111-1111-1111-1111", "5500-0000-0000-0004"]),
    ("amex 3782 822463 10005 1234", ["3782 822463 10005"]),
    ("4111 1111 1111 1111 123-45-6789", ["4111 1111 1111 1111", "123-45-6789"]),
    ("5 4111 1111 1111 1111 743-555-3824", ["4111 1111 1111 1111", "743-555-3824"]),
    ("411111 1111111111 7", ["411111 1111111111"]),
    ("no card 4111 1111 1111 1112 12 and 1234567890123456789012", []),
    ("Dr. Anna Maria Schmidt met", ["Anna Maria Schmidt"]),
    ("Mr. J. Smith met Mrs. J.R.R. Tolkien.", ["J. Smith", "J.R.R. Tolkien"]),
    ("Mr. John Q. Adams Jr. and Mr. O'Brien's dog", ["John Q. Adams Jr", "O'Brien"]),
    ("Prof. Dr. Ludwig van der Rohe, Frau Dr. Eva-Maria von Berg", ["Ludwig van der Rohe", "Eva-Maria von Berg"]),
    ("I met Mr. X. The end", ["X. The"]),
    ("Sir I think, Miss A is one; Mr. Jones. The end", ["Jones"]),
    ("г-н Иван И. Петров", ["Иван И. Петров"]),
])
def test_find_beside_other_words(text, want):
    assert [text[a:b] for a, b, _, _ in S.find(text)] == want


def test_surrogates_keep_type_and_format():
    for a, b, kind, norm, role in S.expand(TEXT, S.find(TEXT)):
        old, new = TEXT[a:b], S.surface(kind, TEXT[a:b], S.surrogate(b"k", kind, norm, 0, role))
        assert new != old
        if kind not in ("part", "ip"):
            assert re.sub(r"\d", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", new)))[:4] == re.sub(r"\d", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", old)))[:4]
            assert len(new) == len(old)
        got = S.find(f" {new} ") if kind != "part" else [(0, 0, "part", "")]
        assert [g[2] for g in got] == [kind], (old, new)
    same = [S.surrogate(b"k", k, n) for _, _, k, n in S.find(TEXT) if k in ("email", "card")]
    assert same[0] == same[1] and same[2] == same[3]
    assert S.surrogate(b"other", "ip", "1.2.3.4") != S.surrogate(b"k", "ip", "1.2.3.4")


def test_more_entities_than_a_pool(spark, monkeypatch):
    """More surnames than syllables make, more mailboxes of one letter than letters: all get their own."""
    monkeypatch.setattr(S, "SYLLABLES", {"latin": ["ba", "be"], "cyrillic": ["ба"]})
    real = S.surrogate

    def limited(key, kind, norm, attempt=0, role=""):
        if attempt > 40:
            raise AssertionError("no end of attempts")
        return real(key, kind, norm, attempt, role)

    monkeypatch.setattr(S, "surrogate", limited)
    found = [("part", f"name{i}", "0123"[i % 4]) for i in range(60)] + [("part", f"имя{i}", "01"[i % 2]) for i in range(5)]
    found += [("email", f"{c}@x.{t}", "") for t in ("com", "org") for c in "abcdefghijklmnopqrstuvwxyz0123456789_"] + [("email", f"_@{c}.com", "") for c in "abcdefgh"]
    got = S.settled(spark.createDataFrame([(*f, False) for f in found], "kind string, norm string, role string, mixed boolean"), b"key").collect()
    assert len(got) == len(found) == len({(r.kind, r.made) for r in got})
    assert not {(r.kind, r.made) for r in got} & {f[:2] for f in found}


@pytest.mark.parametrize("attempt", [0, 9, 30])
def test_longer_surrogates_reach_the_text(attempt):
    for a, b, kind, norm, role in S.expand(TEXT, S.find(TEXT)):
        mention, made = TEXT[a:b], S.surrogate(b"k", kind, norm, attempt, role)
        if kind not in ("part", "email", "ip"):
            assert "".join(c for c in S.surface(kind, mention, made) if c.isalnum()) == made.lstrip("+")
        if kind == "account":
            assert S.iban(made)
        if kind == "card":
            assert S.luhn(made)


@pytest.mark.parametrize("joined", [False, True])
def test_documents(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(S, "BROADCAST_ENTITIES", 0)
        # a surrogate space so small that most entities collide at first
        real = S.surrogate
        monkeypatch.setattr(S, "surrogate", lambda key, kind, norm, attempt=0, role="": real(key, kind, norm, attempt, role) if kind != "ip" or attempt > 8 else f"10.0.0.{S.Stream(key, norm, attempt).draw(40)}")
    rows = [(i, f"from 9.8.7.{i} and {TEXT if i % 7 == 0 else 'no more'}", "pii_spans") for i in range(60)] + [(90, None, None), (91, "", None), (92, "clean text, no 12 numbers", None), (92, "clean text, no 12 numbers", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h string")
    got = S.replace_pii(docs, b"key").orderBy("doc_id").collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[90].text is None and by_id[91].text == "" and by_id[92].text == rows[-1][1]
    ips = set()
    for i, text, _ in rows[:60]:
        new = by_id[i].text
        assert f"9.8.7.{i} " not in new and "example.com" not in new and "Schmidt" not in new
        ips.add(new.split()[1])
        assert re.sub(r"^from \S+ ", "", new) == re.sub(r"^from \S+ ", "", by_id[i % 7 and 1].text)
    assert len(ips) == 60
    assert S.replace_pii(docs.limit(0), b"key").count() == 0


def swapped_texts(spark, texts, key=b"key"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in S.replace_pii(docs, key).orderBy("doc_id").collect()]


def test_one_person_keeps_one_name(spark):
    """Titles, given names and initials beside a name, and mentions without a title, change nothing."""
    got = swapped_texts(spark, ["Mr. John Smith and Dr. John Smith and Mr. Smith agreed. Smith left, John Smith too, SMITH. A smith stayed.", "Frau Smith-Meier met Mr. J. Smith Jr. here", "Smith is free text", "Mrs. Ann Smith"])
    m = re.fullmatch(r"Mr\. (\w+) (\w+) and Dr\. (\w+) (\w+) and Mr\. (\w+) agreed\. (\w+) left, (\w+) (\w+) too, (\w+)\. A smith stayed\.", got[0])
    given, last = m[1], m[2]
    assert m.groups() == (given, last, given, last, last, last, given, last, last.upper()) and "Smith" not in got[0] and given in [x for x in S.GIVEN["latin", "m"]] + [given]
    assert re.fullmatch(rf"Frau {last}-(\w+) met Mr\. [A-Z]\. {last} Jr\. here", got[1])
    assert got[2] == "Smith is free text" and re.fullmatch(rf"Mrs\. \w+ {last}", got[3]) and given not in got[3]


def test_names_stay_distinct_in_the_text(spark):
    """Distinct names, under titles of every gender, show distinct surrogates; given names keep their gender."""
    names = [f"{t} {a}{b}" for t in ("Mr.", "Mrs.", "Dr.") for a in ("Ka", "Lo", "Mi", "Nu") for b in (f"r{x}{y}" for x in "abcdefghij" for y in "klmnopqrst")]
    got = swapped_texts(spark, [f"{n} spoke" for n in names])
    old, new = {}, {}
    for a, b in zip(names, got):
        shown = b.split()[1]
        assert old.setdefault(a.split()[1], shown) == shown and new.setdefault(shown, a.split()[1]) == a.split()[1]
    assert not set(new) & set(old)
    women = swapped_texts(spark, ["Mrs. Anna Kern", "г-жа Анна Петрова", "г-н Иван Петров"])
    assert women[0].split()[1] in S.GIVEN["latin", "f"] and women[1].split()[1] in S.GIVEN["cyrillic", "f"] and women[1].endswith("ва") and women[2].endswith("в")


def test_key_of_the_session(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.org")], "doc_id long, text string")
    default = S.replace_pii(docs).first().text
    spark.conf.set(S.KEY_SETTING, "another")
    try:
        assert S.replace_pii(docs).first().text == S.replace_pii(docs, b"another").first().text != default
    finally:
        spark.conf.unset(S.KEY_SETTING)


def test_initials_stay_distinct():
    for letters in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя"):
        made = [S.surrogate(b"k", "initial", x) for x in letters]
        assert sorted(made) == sorted(letters) and all(a != b for a, b in zip(made, letters))


def test_words_and_further_forms(spark):
    docs = ["Dr. Will spoke. Will you come? We saw Will there.", "Mr. Brown left. Brown bears eat. They met Brown.", "MR. JOHN SMITH came, and Professor Jane Doe.", "Mr. John Smith came. John left too.", "Call 212 555 0134 or 030 1234567, not 1 212 555 0134 77."]
    got = swapped_texts(spark, docs)
    assert re.fullmatch(r"Dr\. (\w+) spoke\. Will you come\? We saw \1 there\.", got[0]) and "Dr. Will" not in got[0]
    assert re.fullmatch(r"Mr\. (\w+) left\. Brown bears eat\. They met \1\.", got[1])
    assert not re.search("JOHN|SMITH|Jane|Doe", got[2]) and got[2].startswith("MR. ")
    m = re.fullmatch(r"Mr\. (\w+) (\w+) came\. (\w+) left too\.", got[3])
    assert m and m[1] == m[3] != "John"
    assert "212 555 0134 or" not in got[4] and "030 1234567" not in got[4] and got[4].endswith("not 1 212 555 0134 77.")


def test_no_known_key_unasked(spark, caplog):
    S._drawn.clear()
    assert S.session_key(spark) == S.session_key(spark) != S.DEMO_KEY and len([r for r in caplog.records if S.KEY_SETTING in r.message]) == 1
    assert S.session_key(spark, b"own") == b"own"
