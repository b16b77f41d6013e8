"""Names, scripts and addresses of surrogates."""

from __future__ import annotations

import re

from strandvote.llm import surrogates


def test_gender_and_script_of_surnames(make):
    rows = [
        (1, "Госпожа Анна Петрова и Господин Петров. Позже Анна Петрова ушла."), (2, "Κυρία Μαρία Παπαδοπούλου, Κύριος Γιώργος Παπαδόπουλος"),
        (3, "Mr. John Smith came. John Smith lives here, said Dr. Smith; Johnny Smithson left."), (4, "Господин Шевченко пришёл"), (5, "Госпожа Вронская и Господин Вронский"),
    ]
    got = {r["doc_id"]: r for r in surrogates.replaced(make(rows)).collect()}
    woman, surname = re.match(r"Госпожа (\w+) (\w+)", got[1]["text"]).groups()
    assert surname.endswith("ова") and re.search(r"Господин (\w+)\.", got[1]["text"])[1] + "а" == surname
    assert f"Позже {woman} {surname} ушла" in got[1]["text"] and got[1]["n_entities"] == 3 and "Петров" not in got[1]["text"]
    she, he = re.match(r"Κυρία (\w+ \w+), Κύριος (\w+ \w+)", got[2]["text"]).groups()
    assert she.endswith("ίδου") and he.endswith("ίδης") and she.split()[1][:-2] == he.split()[1][:-2]
    assert not re.search("[A-Za-z]", got[2]["text"])
    name = re.match(r"Mr\. (\w+ \w+) came", got[3]["text"])[1]
    assert got[3]["text"] == f"Mr. {name} came. {name} lives here, said Dr. {name.split()[1]}; Johnny Smithson left." and got[3]["n_entities"] == 3
    assert got[4]["text"].split()[1].endswith("енко")
    assert got[5]["text"].split()[1] == got[5]["text"].split()[4] + "а"


def test_ip6(make):
    texts = ["2001:db8::8a2e:370:7334", "2001:0DB8:0000:0000:0000:8A2E:0370:7334", "at fe80::1.", "12:30:45 and 00:1a:2b:3c:4d:5e and std::dec"]
    got = {r["doc_id"]: r["text"] for r in surrogates.replaced(make(list(enumerate(texts)))).collect()}
    short, long = got[0], got[1]
    assert short != texts[0] and [len(x) for x in short.split(":")] == [len(x) for x in texts[0].split(":")]
    a, b = short.split("::")
    assert [x.lstrip("0").lower() or "0" for x in long.split(":")] == [*a.split(":"), "0", "0", "0", *b.split(":")]  # one address, two formats
    assert re.fullmatch(r"at [0-9a-f]{4}::[0-9a-f]\.", got[2]) and got[2] != texts[2] and got[3] == texts[3]


def test_one_person_has_one_name(make):
    """Titles without a gender take that of another mention in the document."""
    rows = [(1, "Mrs. Elizabeth Brown came. Dr. Elizabeth Brown spoke. Then Elizabeth Brown left."), (2, "Dr. Andrea Rossi and Mr. Andrea Rossi; Mrs. Andrea Rossi too")]
    got = {r["doc_id"]: r["text"] for r in surrogates.replaced(make(rows)).collect()}
    name = re.match(r"Mrs\. (\w+ \w+) came", got[1])[1]
    assert got[1] == f"Mrs. {name} came. Dr. {name} spoke. Then {name} left." and name.split()[0].endswith("a") | (name.split()[0] in ("Irene",))
    men = re.match(r"Dr\. (\w+ \w+) and Mr\. (\w+ \w+); Mrs\. (\w+ \w+) too", got[2]).groups()
    assert men[0].split()[1] == men[1].split()[1] == men[2].split()[1] and men[1] != men[2]


def test_long_names_possessives_and_forms(make):
    rows = [(1, "Ms. Mary Jane Watson came; Mary Jane Watson left."), (2, "Mr. John Smith's dog, and John Smith’s cat. Mr. John Smith"), (3, "Mr. JOHN SMITH and Mr. John Smith"), (4, "Mrs. Anne-Marie Smith-Jones and Mr. D'Arcy O'Neil"), (5, "Mr. Ross's car")]
    got = {r["doc_id"]: r["text"] for r in surrogates.replaced(make(rows)).collect()}
    name = re.match(r"Ms\. (\w+ \w+) came", got[1])[1]
    assert got[1] == f"Ms. {name} came; {name} left." and not re.search("Mary|Jane|Watson", got[1])
    name = re.match(r"Mr\. (\w+ \w+)'s dog", got[2])[1]
    assert got[2] == f"Mr. {name}'s dog, and {name}’s cat. Mr. {name}"
    loud, plain = re.match(r"Mr\. (.+) and Mr\. (.+)", got[3]).groups()
    assert loud == plain.upper() and plain == name
    assert re.fullmatch(r"Mrs\. \w+-\w+ \w+-\w+ and Mr\. \w+ \w+", got[4]) and not re.search("Anne|Marie|Smith|Jones|Arcy|Neil", got[4])
    assert re.fullmatch(r"Mr\. \w+'s car", got[5]) and "Ross" not in got[5]
