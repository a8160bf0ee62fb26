import re

import pytest

from loomtext.llm import license_scan
from loomtext.llm.common import alnum_words
from loomtext.llm.license_scan import BASE_PHRASES, TEMPLATES, LicenseScanner, compile_template, scan_licenses, templates_of
from loomtext.llm.queries import op9_license_scan

SCANNER = LicenseScanner(TEMPLATES, BASE_PHRASES)


def plain(text):
    """The base columns by plain loops."""
    words = alnum_words(text)
    places = []
    for phrase, label in BASE_PHRASES.items():
        want = phrase.encode().split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(want)] == want]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def nodes_of(template):
    """A template as nested lists: words, numbers of free words, optional regions."""
    stack = [[]]
    for part in re.split(r"(<<.*?>>)", template, flags=re.S):
        if part.startswith("<<begin"):
            stack.append([])
        elif part.startswith("<<end"):
            inner = stack.pop()
            stack[-1].append(inner)
        elif part.startswith("<<var"):
            stack[-1].append(int(re.search(r"max=(\d+)", part)[1]))
        else:
            stack[-1] += alnum_words(part)
    return stack[0]


def ends(nodes, words, at):
    """All places where the nodes can end that begin at ``at``, by trying everything."""
    now = {at}
    for node in nodes:
        after = set()
        for k in now:
            if isinstance(node, bytes):
                after |= {k + 1} if words[k : k + 1] == [node] else set()
            elif isinstance(node, int):
                after |= {k + j for j in range(node + 1) if k + j <= len(words)}
            else:
                after |= {k} | ends(node, words, k)
        now = after
    return now


TREES = {label: nodes_of(t) for label, t in TEMPLATES.items()}


def plain_result(text):
    """labels and score by plain loops: of every place of the mandatory words the widest stretch."""
    words, covered, labels = alnum_words(text), set(), set()
    for phrase, label in BASE_PHRASES.items():
        want = phrase.encode().split()
        for k in range(len(words)):
            if words[k : k + len(want)] == want:
                labels.add(label)
                covered |= set(range(k, k + len(want)))
    for label, tree in TREES.items():
        leading = next(k for k, node in enumerate(tree) if not isinstance(node, list))
        head, rest = tree[:leading], tree[leading:]
        for k in (j for j in range(len(words)) if words[j] == rest[0]):
            if stop := ends(rest, words, k):
                begin = min(b for b in range(max(0, k - 60), k + 1) if k in ends(head, words, b))
                labels.add(label)
                covered |= set(range(begin, max(stop)))
    return ",".join(sorted(labels)), len(covered) / len(words) if words else 0.0


def fill(template, optional, words):
    text = re.sub(r"<<var[^>]*>>", words, template)
    while not optional and "<<begin" in text:  # the innermost regions first
        text = re.sub(r"<<beginOptional>>((?!<<begin).)*?<<endOptional>>", "", text, flags=re.S)
    return re.sub(r"<<beginOptional>>|<<endOptional>>", "", text)


@pytest.mark.parametrize("label", TEMPLATES)
@pytest.mark.parametrize("optional", [True, False])
def test_templates_accept_their_own_text(label, optional):
    text = "Intro words. " + fill(TEMPLATES[label], optional, "some").upper() + " And more."
    assert label in SCANNER.digest(text)[5].split(",")
    assert SCANNER.digest(text)[5:] == plain_result(text)


def test_optional_regions_before_the_mandatory_words_belong_to_the_match():
    text = "Notes\n\nMIT License\n\nCopyright (c) 2020 Some Body\n\n" + fill(TEMPLATES["mit-text"], False, "the authors")
    assert SCANNER.scan(text).stretches == [(1, len(alnum_words(text)), "mit-text")]
    assert SCANNER.digest(text)[5:] == plain_result(text)
    without = text.replace("MIT License", "A license")
    assert SCANNER.scan(without).stretches[0][0] == 3 and SCANNER.digest(without)[5:] == plain_result(without)
    automaton = compile_template("<<beginOptional>>a <<beginOptional>>b<<endOptional>> c<<endOptional>> <<beginOptional>>d <<var;max=2>><<endOptional>> x y")
    for said, begin in (("a b c d 1 2 x y", 0), ("a c x y", 0), ("a b d x y", 2), ("b c x y", 2), ("c d 1 2 3 x y", 5)):
        words = said.encode().split()
        assert automaton.match(words, len(words) - 2) == (begin, len(words))


def test_anchors_stand_anywhere():
    """Openings that are replaceable or short, against everything that plain loops can find."""
    templates = {
        "a": "<<var;max=3>> may be used freely by anyone",
        "b": "Copyright <<var;max=4>> all rights reserved by the holder",
        "c": "<<beginOptional>>The<<endOptional>> License <<beginOptional>>version<<endOptional>> two applies",
        "d": "one <<var;max=2>> two",
    }
    texts = [
        "The code may be used freely by anyone", "may be used freely by anyone", "one two three four may be used freely by anyone else",
        "Copyright 2020 Some Body all rights reserved by the holder", "Copyright a b c d e all rights reserved by the holder",
        "all rights reserved by the holder", "Copyright all rights reserved by the holder Copyright all rights reserved by the holder",
        "the license version two applies", "License two applies here", "license version applies", "two applies",
        "one two", "one 1 2 two two", "one one 2 3 two", "two one", "",
    ]
    scanner, hits = LicenseScanner(templates, {}), 0
    for text in texts:
        words = alnum_words(text)
        found = scanner.scan(text).stretches
        for label, template in templates.items():
            tree = nodes_of(template)
            spans = {(b, e) for b in range(len(words) + 1) for e in ends(tree, words, b)}
            own = {(b, e) for b, e, x in found if x == label}
            assert own <= spans and bool(own) == bool(spans)
            for b, e in spans:
                assert any(x <= b and e <= y for x, y in own)
            hits += len(own)
    assert hits == 12


def test_templates_of_a_table(spark, monkeypatch):
    table = spark.createDataFrame([("x", "a b c"), ("y", None), ("z", "c <<var;max=2>> d")], "label string, template string")
    assert templates_of(table) == {"x": "a b c", "z": "c <<var;max=2>> d"} and templates_of(table.limit(0)) == {}
    for rows in ([("x", "a b"), ("x", "c d")], [(None, "a b")]):
        with pytest.raises(ValueError):
            templates_of(spark.createDataFrame(rows, "label string, template string"))
    monkeypatch.setattr(license_scan, "TEMPLATE_BYTES", 10)
    with pytest.raises(ValueError):
        templates_of(table)


def test_mandatory_wording_must_match():
    text = fill(TEMPLATES["mit-text"], False, "X")
    assert "mit-text" in SCANNER.digest(text)[5]
    for word in ("hereby", "MERCHANTABILITY", "DEALINGS", "free of charge"):
        assert "mit-text" not in SCANNER.digest(text.replace(word, "other"))[5]
    for label, word in (("isc-text", "TORTIOUS"), ("bsd-text", "EXEMPLARY"), ("bsd-text", "ADVISED")):
        full = fill(TEMPLATES[label], True, "X")
        assert label in SCANNER.digest(full)[5] and label not in SCANNER.digest(full.replace(word, "other"))[5]
    assert "mit-text" not in SCANNER.digest(fill(TEMPLATES["mit-text"], False, "x " * 30))[5]


def test_bad_markup():
    for text in ("<<beginOptional>> a b", "a b <<endOptional>>", "<<var;max=3>> a b", "a b <<what>>", "a"):
        with pytest.raises(ValueError):
            compile_template(text)


def test_nested_optional_regions():
    automaton = compile_template("a b <<beginOptional>>c <<beginOptional>>d<<endOptional>> e<<endOptional>> f")
    for text, end in (("a b f", 3), ("a b c e f x", 5), ("a b c d e f", 6), ("a b c f", None), ("a b d f", None)):
        assert automaton.longest(text.encode().split(), 0) == end


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = op9_license_scan(spark, sf).collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id])
        assert (r.labels, r.score) == plain_result(texts[r.doc_id])


def test_rows(spark):
    rows = [(1, "Under the MIT License", 5), (1, "Under the MIT License", 5), (None, "", 7), (3, None, 8), (4, "cc by nc " * 20000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels long")
    got = {r.doc_id: r for r in scan_licenses(df, digest=True).collect()}
    assert got[4].n_base == 20000 and got[1].labels == "mit,mit-notice" and got[None].n_words == 0 == got[3].score
    assert scan_licenses(df).count() == 5 and scan_licenses(df.limit(0)).count() == 0
