"""Surrogates (3), license templates (7) and decontamination (9)."""

from __future__ import annotations

import random
import re

import pytest

from strandvote.llm import decontamination, licenses, surrogates

PII = [
    (1, "Call Mr. John Smith at +1 (663) 555-6869 or 663-555-6869, mail John.Smith@Mail.example.com and john.smith@mail.example.com."),
    (2, "Mrs. Ann Smith and Ms. Smith; ip 10.0.0.1 card 4111 1111 1111 1111 and 4111111111111111 iban DE89 3704 0044 0532 0130 00 ssn 123-45-6789"),
    (3, 'Госпожа Анна Петрова token = "11acdfb36bb72224148e6160f674b4be45601bff" 10.0.0.1'),
    (4, "version 2.0 in 1999, 3 apples, 12:30 and (c) 2020"),
]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_surrogates_keep_type_format_and_identity(make):
    got = {r["doc_id"]: r for r in surrogates.replaced(make(PII)).collect()}
    one, two, three = got[1]["text"], got[2]["text"], got[3]["text"]
    for old in ("John", "Smith", "663", "6869", "Ann", "4111", "10.0.0.1", "DE89", "123-45", "Анна", "11acdf"):
        assert old not in one + two + three
    a, b = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4})", one)[0][:3], re.findall(r" or (\d{3})-(\d{3})-(\d{4})", one)[0]
    assert a == b
    mails = re.findall(r"\S+@\S+\.com", one)
    assert mails[0] != mails[1] and mails[0].lower() == mails[1] and mails[0][0].isupper()
    surname = re.search(r"Mr\. \w+ (\w+) at", one)[1]
    assert re.search(rf"Mrs\. \w+ {surname} and Ms\. {surname};", two)
    given = re.search(r"Mrs\. (\w+) ", two)[1]
    assert given in surrogates._GIVEN["f", "latin"] and re.search(r"Mr\. (\w+) ", one)[1] in surrogates._GIVEN["m", "latin"]
    cards = re.search(r"card ([\d ]{19}) and (\d{16})", two)
    assert cards[1].replace(" ", "") == cards[2] and luhn(cards[2]) % 10 == 0
    assert re.search(r"iban DE\d\d( \d{4}){4} \d\d ssn \d{3}-\d\d-\d{4}", two)
    assert re.search(r"ip (\S+) card", two)[1] == three.rsplit(" ", 1)[1]
    assert re.search(r"Госпожа [А-Я]\w+ [А-Я]\w+ ", three) and re.search(r'"[0-9a-f]{40}"', three)
    assert got[4]["text"] == PII[3][1] and got[4]["n_entities"] == 0


def test_surrogates_are_keyed_distinct_and_repeatable(make):
    rows = [(i, f"10.0.{i // 250}.{i % 250} user{i}@example.com") for i in range(600)]
    a = {r["doc_id"]: r["text"] for r in surrogates.replaced(make(rows)).collect()}
    assert len(set(a.values())) == 600 and len({t.split()[0] for t in a.values()}) == 600
    assert not {t.split()[0] for t in a.values()} & {t.split()[0] for _, t in rows}
    assert a == {r["doc_id"]: r["text"] for r in surrogates.replaced(make(rows).repartition(7)).collect()}
    assert a != {r["doc_id"]: r["text"] for r in surrogates.replaced(make(rows), key="other").collect()}


def test_collisions_are_drawn_again(spark):
    rows = [(f"{i:03d}-45-678{j}",) for i in range(300) for j in range(3)] + [(f"Mr. A{chr(97 + i)}{chr(97 + j)} Bee",) for i in range(20) for j in range(20)]
    found = surrogates.entities(spark.createDataFrame(rows, "mention string"))
    out = surrogates.cores(found).toPandas()
    assert not out.duplicated(["kind", "core"]).any() and len(out) == 900 + 400 + 1
    assert not set(out["core"]) & set(out["canon"])


def test_surrogates_of_odd_rows(odd, nothing):
    got = surrogates.replaced(odd).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted((r["doc_id"] or 0, r["text"] or "") for r in odd.collect())
    assert surrogates.replaced(nothing).count() == 0
    assert any(r["text"] is None for r in got)


def test_surrogates_use_no_python(odd, capsys):
    surrogates.replaced(odd).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", {"mit", "mit-notice"}),
        ("see the MIT\nLicense", {"mit"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-notice"}),
        ("licensed under the terms of the GNU Lesser General Public License", {"gpl", "gpl-notice"}),
        ("licensed under the GNU Public License", set()),
        ("Licensed under the Apache License, Version 2.0. ALL RIGHTS RESERVED", {"apache", "apache-2.0-notice", "all-rights-reserved"}),
        ("permission is hereby granted, free of charge, to any person obtaining a copy of this software and files, to deal in the Software without restriction.", {"mit-text"}),
        ("permission is hereby granted, free of charge, to any person obtaining a copy of one two three four five six seven eight nine to deal in it without restriction", set()),
        ("licensed under a Creative Commons Attribution 4.0 International License", {"cc-by-notice"}),
        ("smit license", set()),
    ],
)
def test_licenses(make, text, labels):
    row = licenses.scan(make([(1, text)])).first()
    assert {m["label"] for m in row["matches"]} == labels


def test_license_places_and_odd_rows(odd, nothing, make):
    row = licenses.scan(make([(1, "MIT License mit license x MIT license")])).first()
    assert [(m["start"], m["end"]) for m in row["matches"] if m["base"]] == [(0, 2), (2, 4), (5, 7)]
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(nothing).count() == 0
    assert licenses.scan(make([(1, "the mit"), (2, "license")])).where("size(matches) > 0").count() == 0


def test_automaton_of_markup():
    a = licenses.compile_template("t", "a [[b {{2}} c]] d {{1}} e")
    run = lambda s: a.run(licenses.hashes(s))[0]
    assert [run(s) for s in ("a d e", "a d x e", "a b c d e", "a b x y c d e", "a b x y z c d e", "a d x y e", "a d", "")] == [3, 4, 5, 7, 0, 0, 0, 0]
    assert a.mandatory == 3


def distance(a, b):
    """Least edits of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_bit_vector_distance():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 70))] for _ in range(2))
        assert decontamination.best_edits(a, b) == distance(a, b)


def leak_case():
    rng = random.Random(5)
    common = ["the", "of", "and", "to", "in"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(10, 60)))) for i in range(60)]
    docs, want = [], {}
    for d in range(240):
        text = [word() for _ in range(rng.randrange(0, 200))]
        if d % 2 == 0:
            i, item = rng.choice(items)
            words = item.split()
            for _ in range(rng.randrange(0, int(len(words) * 0.2) + 1) if d % 4 else 0):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [word()], [words[at], word()]])
            at = rng.randrange(len(text) + 1)
            text[at:at] = words
        docs.append((d, " ".join(text).upper() if d % 8 == 0 else ", ".join(text)))
        plain = docs[-1][1].lower().replace(",", "").split()
        want[d] = {i for i, item in items if distance(item.split(), plain) <= int(len(item.split()) * 0.2)}
    return items, docs, want


def test_leaks_are_found_with_the_recall_asked_for(spark, make):
    items, docs, want = leak_case()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: {h["item_id"] for h in r["hits"]} for r in decontamination.find(make(docs), benchmark).collect()}
    true = sum(len(x) for x in want.values())
    assert true > 100 and sum(len(got[d] & want[d]) for d in want) / true >= 0.95
    assert all(got[d] <= want[d] for d in want)
    exact = {d: {i for i, item in items if f" {item} " in f" {t.lower().replace(',', '')} "} for d, t in docs}
    assert all(exact[d] <= got[d] for d in exact)


def test_leaks_of_odd_rows(spark, odd, nothing, make):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (None, "some words that are long enough to be an item of it"), (4, "a b c d e f g h i j k l"), (4, "a b c d e f g h i j k l")], "item_id long, text string")
    assert decontamination.find(odd, benchmark).where("size(hits) > 0").count() == 0
    assert decontamination.find(odd, benchmark.limit(0)).count() == odd.count() == decontamination.clean(odd, benchmark).count()
    assert decontamination.find(nothing, benchmark).count() == 0
    docs = make([(1, "A b c d E f g h i j k l"), (2, "x A b c d f g h i j k l y"), (3, "a b c"), (4, "a b c d e f x"), (5, "g h i j k l")])
    hits = {r["doc_id"]: [(h["item_id"], h["edits"]) for h in r["hits"]] for r in decontamination.find(docs, benchmark).collect()}
    assert hits == {1: [(4, 0), (4, 0)], 2: [(4, 1), (4, 1)], 3: [], 4: [], 5: []}
    assert sorted(r["doc_id"] for r in decontamination.clean(docs, benchmark).collect()) == [3, 4, 5]


def test_blocks_hold_each_item_once(spark):
    items, _, _ = leak_case()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = list(decontamination.indexes(benchmark, block=700))
    assert len(found) > 1 and sorted(i for x in found for i in x.ids) == [i for i, _ in items]
