"""License scans (7), distribution rules (6), surrogates (3) and the pipeline against plain versions of themselves."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from strandvote.llm import decontamination, licenses, near_dedup, quality_rules, surrogates
from strandvote.llm import queries as llm

from .test_dedup import sets_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def tokens_of(markup):
    return re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup)


def as_pattern(tokens):
    """A regular expression over words that each have a blank behind them."""
    form = lambda t: {"[[": "(?:", "]]": ")?"}.get(t) or (rf"(?:\S+ ){{0,{t[2:-2]}}}" if t[0] == "{" else re.escape(t) + " ")
    return re.compile(r"(?<!\S)" + "".join(map(form, tokens)))


def up_to_mandatory(markup):
    """Patterns of a template up to its 1st, 2nd, ... mandatory word; the first words that stand side by side, three at most, count as one step."""
    tokens, deep, ends, head, side = tokens_of(markup), 0, [], 0, True
    for i, t in enumerate(tokens):
        deep += (t == "[[") - (t == "]]")
        if t[0] not in "[]{" and not deep:
            ends.append(i + 1)
            head += side and head < 3
        elif ends:
            side = False
    return [as_pattern(tokens[:e]) for e in ends], head


def best_share(patterns, head, text):
    low, high = head - 1, len(patterns)  # the most mandatory words that stand in order
    while low < high:
        middle = (low + high + 1) // 2
        if patterns[middle - 1].search(text):
            low = middle
        else:
            high = middle - 1
    return low / len(patterns) if low >= head else 0.0


def written_out(markup, rng):
    """A text that the template accepts."""
    out, skipping, deep = [], [], 0
    for t in tokens_of(markup):
        if t == "[[":
            deep += 1
            if rng.random() < 0.5:
                skipping.append(deep)
        elif t == "]]":
            if skipping and skipping[-1] == deep:
                skipping.pop()
            deep -= 1
        elif not skipping:
            out += [f"any{rng.randrange(99)}" for _ in range(rng.randrange(int(t[2:-2]) + 1))] if t[0] == "{" else [t]
    return out


def test_licenses_equal_regular_expressions(make):
    rng, rows = random.Random(3), []
    for i, (label, markup) in enumerate(list(licenses.TEMPLATES.items()) * 6):
        words = written_out(markup, rng)
        for _ in range(rng.choice([0, 0, 1, 2])):  # words lost, changed or put in
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["other"], [words[at], "more"], words[at : at + 1] * 2])
        around = lambda: [rng.choice(["filler", "the", "mit", "license", "licensed", "é1", "apache"]) for _ in range(rng.randrange(6))]
        words = [w.upper() if rng.random() < 0.2 else w for w in around() + words + around()]
        rows.append((i, rng.choice([" ", "\n", ", "]).join(words)))
    rows += [(900, None), (901, "General Public License general public license")]
    got = {r["doc_id"]: r for r in licenses.scan(make(rows)).collect()}
    whole = {label: as_pattern(tokens_of(m)) for label, m in licenses.TEMPLATES.items()}
    steps = [up_to_mandatory(m) for m in licenses.TEMPLATES.values()]
    accepted = 0
    for d, text in rows:
        words = plain_words(text)
        joined, row = "".join(f"{w} " for w in words), got[d]
        base = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        assert row["n_words"] == len(words) and sorted((m["start"], m["label"]) for m in row["matches"] if m["base"]) == base
        assert {m["label"] for m in row["matches"] if not m["base"]} == {label for label, p in whole.items() if p.search(joined)}, text
        assert row["partial"] == pytest.approx(max(best_share(p, head, joined) for p, head in steps)), text
        accepted += any(not m["base"] for m in row["matches"])
    assert len(rows) * 0.3 < accepted < len(rows) * 0.95


def class_of(c):
    if ord(c) > 127:
        return "wide"
    for name, members in (("lower", str.islower), ("upper", str.isupper), ("digit", str.isdigit)):
        if members(c):
            return name
    return "space" if c in " \t\n\v\f\r" else "stop" if c in ".,;:'\"?()-" else "symbol" if c in "#*$%&|<>" else "other_ascii"


def shares(counts):
    total = sum(counts.values())
    return {x: n / total for x, n in counts.items()} if total else {}


def distance(p, q):
    d = 0.0
    for x in set(p) | set(q):
        a, b = p.get(x, 0), q.get(x, 0)
        d += (a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0)
    return math.sqrt(min(max(d / 2, 0), 1))


def ruled_by_brute_force(rows):
    """doc_id -> (class distance, word distance, nearest, kept), from counters of characters and words."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    refs = {}
    for lang in sorted({x for _, t, x in rows if x and t is not None}):
        mine = [t for _, t, x in rows if x == lang and t is not None]
        words = Counter(w for t in mine for w in split(t))
        common = dict(words.most_common(quality_rules.COMMON))
        refs[lang] = shares(Counter(class_of(c) for t in mine for c in t)), common, shares(Counter(common | {"": sum(words.values()) - sum(common.values())}))
    out = {}
    for d, text, _ in rows:
        words, chars = split(text), shares(Counter(map(class_of, text or "")))
        found = []
        for lang, (classes, common, of_words) in refs.items():
            own = shares(Counter(w if w in common else "" for w in words))
            found.append((distance(chars, classes), distance(own, of_words), lang))
        by_class, by_word, nearest = min(found, key=lambda x: x[0] + x[1])
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        again = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
        far = by_class > quality_rules.CLASS_LIMIT and len(text or "") >= quality_rules.CLASS_LEAST or by_word > quality_rules.WORD_LIMIT and len(words) >= quality_rules.WORD_LEAST
        out[d] = by_class, by_word, nearest, not failed and not far
    return out


def test_distances_equal_counters(make):
    """Three languages whose words have frequencies of their own, so that none ties for the last common place."""
    rng, rows = random.Random(8), []
    for lang, letters in (("aa", "abcdefg"), ("bb", "hijklmnop"), ("cc", "абвгдежз")):
        vocabulary = [f"{rng.choice(letters)}{rng.choice(letters)}{i}" for i in range(80)]
        words = [w + rng.choice(["", "", ".", "!"]) * (i > 60) for i, w in enumerate(vocabulary) for _ in range(220 - 2 * i)]
        rng.shuffle(words)
        while words:
            n = rng.choice([1, 8, 30, 90, 300])
            rows.append((len(rows), " ".join(words[:n]), lang))
            words = words[n:]
    rows += [(len(rows) + i, rng.choice(["# $ %", "XX YY", "é7 ö8"]).join(f"{rng.choice('QZ#')}{rng.randrange(10**6)} " for _ in range(n)), None) for i, n in enumerate([3, 40, 80, 200])]
    rows += [(900, None, "aa"), (901, "one two three four five six seven eight nine ten " * 12, None)]
    docs = make(rows)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, quality_rules.references(docs)).collect()}
    want = ruled_by_brute_force(rows)
    for d, text, _ in rows:
        if text:
            assert (got[d]["class_distance"], got[d]["word_distance"]) == pytest.approx(want[d][:2], abs=1e-9) and got[d]["nearest"] == want[d][2], text
        assert got[d]["kept"] == want[d][3], text
    assert 0.2 < sum(x[3] for x in want.values()) / len(want) < 1


#: kind -> a planted entity, written in one or two formats.
def planted(kind, i, rng):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        local = f"user{i}.{rng.choice('abc')}@mail{i % 7}.example.org"
        return [local, local.upper()]
    if kind == "phone":
        a, b, c = digits(3), digits(3), digits(4)
        return [f"({a}) {b}-{c}", f"+1 {a}-{b}-{c}", f"{a}.{b}.{c}"]
    if kind == "ip":
        return [f"10.{i % 250}.{rng.randrange(250)}.{rng.randrange(250)}"]
    if kind == "ssn":
        return [f"{digits(3)}-{digits(2)}-{digits(4)}"]
    if kind == "card":
        d = digits(16)
        return [d, " ".join(d[j : j + 4] for j in range(0, 16, 4))]
    if kind == "secret":
        return ["sk-" + "".join(rng.choice("abcXYZ0189") for _ in range(rng.randrange(20, 90)))]
    given, surname = rng.choice(["Anton", "Berta", "Clemens"]), "".join(rng.choice("aeiourstlmn") for _ in range(7)).capitalize()
    return [f"Mr. {given} {surname}", f"Mr {surname}"] if i % 2 else [f"Mrs. {given} {surname}"]


def test_planted_entities_are_replaced_by_others_of_their_own(make):
    """Every planted mention goes; two entities never share a surrogate, and one entity has one, in the format of each mention."""
    rng, rows, plan = random.Random(12), [], {}
    kinds = ["email", "phone", "ip", "ssn", "card", "secret", "name"]
    known = [(k, planted(k, i, rng)) for i in range(40) for k in kinds]
    for d in range(150):
        mentions = [known[0] if rng.random() < 0.3 else rng.choice(known) for _ in range(rng.randrange(6))]  # one hot entity
        plan[d] = [(k, forms[0], rng.choice(forms)) for k, forms in mentions]
        rows.append((d, "start" + "".join(f" |{d}q{j}| {m} |end|" for j, (_, _, m) in enumerate(plan[d])) + " stop"))
    got = {r["doc_id"]: r for r in surrogates.replaced(make(rows)).collect()}
    surrogate, entity_of = {}, {}
    bare = lambda k, x: re.sub(r"\D", "", x)[-10:] if k == "phone" else re.sub(r"\D", "", x) if k == "card" else x.lower() if k == "email" else x.split()[-1] if k == "name" else x
    for d, of in plan.items():
        text = got[d]["text"]
        assert got[d]["n_entities"] == len(of) and text.startswith("start") and text.endswith(" stop")
        new = re.findall(r"\|\d+q\d+\| (.*?) \|end\|", text)
        assert len(new) == len(of)
        for (kind, entity, mention), x in zip(of, new, strict=True):
            assert x != mention and bare(kind, x) != bare(kind, mention)
            assert re.sub(r"\w", "w", x) == re.sub(r"\w", "w", mention) or kind in ("ip", "name")
            name = kind, bare(kind, entity)
            assert surrogate.setdefault(name, bare(kind, x)) == bare(kind, x)
            assert entity_of.setdefault((kind, bare(kind, x)), name) == name
    assert len(surrogate) > 150 and not {x for _, x in surrogate} & set(surrogate.values())


def test_pipeline_equals_its_stages_done_plainly(spark, sf_dir):
    """Of what the classifier accepts: near-duplicates by comparing all pairs, leaks by all edit distances, mix and shards by SQL."""
    import duckdb

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()}
    ids = sorted(rows)
    sets, label = dict(zip(ids, sets_of([(d, rows[d]) for d in ids]), strict=True)), {d: d for d in ids}

    def end(d):
        return d if label[d] == d else end(label[d])

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= near_dedup.STAGE.limit * (len(sets[a]) + len(sets[b]) - both):
                label[max(end(a), end(b))] = min(end(a), end(b))
    items = [plain_words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def leaks(text):
        words = plain_words(text)
        have = set(words)
        return any(sum(w not in have for w in x) <= decontamination.allowed(len(x)) and decontamination.best_edits(x, words) <= decontamination.allowed(len(x)) for x in items if x)

    left = [d for d in ids if end(d) == d and not leaks(rows[d])]
    assert 0 < len(left) < len([d for d in ids if end(d) == d]) <= len(ids)
    con = duckdb.connect()
    con.register("documents", docs.where(docs.doc_id.isin(left)).toPandas())
    (name,) = [x for x in llm.ORACLE_SQL if x.startswith("op4")]
    mix = con.execute(llm.ORACLE_SQL[name]).df()
    copies = {int(d): int(taken // size) for d, size, taken in zip(mix["doc_id"], mix["size"], mix["taken"], strict=True) if size}
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert got["doc_id"].value_counts().to_dict() == {d: n for d, n in copies.items() if n}
    counts = got.groupby("shard")["slot"]
    assert counts.count().max() - counts.count().min() <= 1 and (counts.max() == counts.count() - 1).all() and (counts.nunique() == counts.count()).all()
