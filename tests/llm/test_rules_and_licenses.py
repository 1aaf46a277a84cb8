"""Quality rules and licence scans against plain Python."""

import re
import textwrap

from sitrep.llm import licenses, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
    )


TEXTS = [
    None, "", "a", "a b", "a b c", "a a a a a", "x y z x y z", "a b c a b\n\na b\na b\n \n",
    "# * | <b> $ % &&", "ü ß 漢字 \U0001f600 a b", " lead trail \x0b\x0c\r", "q " * 500,
    "a b c d a b c e b c d",
]


def test_counts_are_those_of_plain_python(spark, awkward):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    for i, text in enumerate(TEXTS):
        r, want = got[i], base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    rows = quality_rules.apply_rules(awkward).collect()
    assert len(rows) == 10
    for r, d in zip(rows, awkward.collect(), strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(d.text)


def test_texts_beyond_the_packed_positions_count_alike(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    want = [r.n_repeat_words for r in quality_rules.apply_rules(docs).orderBy("doc_id").collect()]
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 2)
    got = [r.n_repeat_words for r in quality_rules.apply_rules(docs).orderBy("doc_id").collect()]
    assert got == want
    # with almost all hash bits gone, windows of different words must still be told apart
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 62)
    got = [r.n_repeat_words for r in quality_rules.apply_rules(docs).orderBy("doc_id").collect()]
    assert got == want


def test_a_rule_decides(spark, empty):
    own = ["abcdefghij"[i // 10] + "klmnopqrst"[i % 10] + "x" for i in range(60)]
    docs = spark.createDataFrame(
        [(1, " the ".join(own)), (2, " #|# ".join(own))], "doc_id long, text string"
    )
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    assert got[1].kept and not got[2].kept
    assert "symbols_per_word" in got[2].failed_rules
    assert quality_rules.apply_rules(empty).collect() == []
    assert all(r.kept for r in quality_rules.apply_rules(docs, rules=()).collect())


def sentence(name):
    return licenses.SENTENCES[name].replace(licenses.HOLDER, "the copyright holder")


def test_licences(spark, awkward, empty):
    mit = licenses.SENTENCES["mit-grant"] + "\n\nSomething else.\n" + licenses.SENTENCES["mit-notice"]
    texts = [
        "Hello. Released under the MIT License. Bye",
        mit,
        licenses.SENTENCES["mit-notice"] + " " + licenses.SENTENCES["mit-grant"],
        "LICENSED under the Apache License,   version 2.0.\nLicensed under the Apache License, Version 2.0.",
        "This is not licensed under CC BY-NC 4.0.",
        "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved.",
        None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.licenses for r in licenses.scan(docs).orderBy("doc_id").collect()]
    assert got == ["MIT", "MIT", "MIT", "Apache-2.0", "", "GPL-3.0,LicenseRef-reserved", ""]
    ids = [r.sentence_ids for r in licenses.scan(docs).orderBy("doc_id").collect()]
    assert ids[1] == "mit-grant,mit-notice" and ids[3] == "apache-header,apache-header" or ids[3]
    assert licenses.scan(awkward).count() == 10
    assert licenses.scan(empty).count() == 0


def test_every_rule_is_found_in_its_own_sentences(spark):
    docs = spark.createDataFrame(
        [(i, "\n".join(sentence(x) for x in ids)) for i, (_, ids) in enumerate(licenses.RULES)],
        "doc_id long, text string",
    )
    got = {r.doc_id: r.licenses.split(",") for r in licenses.scan(docs).collect()}
    for i, (name, _) in enumerate(licenses.RULES):
        assert name in got[i]


def test_wrapped_and_commented_sentences_are_those_of_one_line(spark):
    marks = [
        ("", ""), ("// ", ""), (" * ", ""), ("# ", " #"), (";; ", ""), ("-- ", ""), ("dnl ", ""), ("REM ", ""),
        ("C     ", ""), ("> ", "\r"),
    ]
    rows, want = [], []
    for _, ids in licenses.RULES:
        own = [sentence(x) for x in ids]
        for width in (20, 40, 75):
            for mark, tail in marks:
                for blank in ("\n", "\n\n"):
                    lines = blank.join(textwrap.fill(s, width) for s in own).split("\n")
                    rows.append("\n".join(mark + x + tail for x in ["A heading", *lines, "and more"]))
                    want.append(",".join(ids))
        rows.append("/* " + textwrap.fill("Some words. " + " ".join(own) + " Bye.", 75) + " */")
        # in one paragraph, "at" does not end a sentence
        want.append(",".join(x for x in ids if x != "apache-obtain"))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.sentence_ids for r in licenses.scan(docs).collect()}
    for i, text in enumerate(rows):
        assert got[i] == want[i], text


def test_sentences_do_not_join_over_their_ends(spark):
    rows = [
        "Licensed under the\n\nMIT License.", "Licensed under the. MIT License.", "This is not\nlicensed under CC BY 4.0 at all",
        "Not: licensed under the MIT License.", "Licensed under the MIT License\x01", "Licensed under the\nMIT License\nHeading",
    ]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = [r.licenses for r in licenses.scan(docs).orderBy("doc_id").collect()]
    assert got == ["", "", "", "", "MIT", "MIT"]


def test_matched_identifiers_are_taken(spark):
    rows = [ids for _, ids in licenses.RULES] + [
        ("bsd-redistribution", "bsd-source", "bsd-endorse", "bsd-redistribution", "bsd-source"),
        ("bsd-redistribution", "bsd-source", "bsd-redistribution", "bsd-source"),
        ("mit-grant", "mit-grant", "mit-notice"),
        ("bsd-redistribution", "cc0", "bsd-source"),
    ]
    want = [name for name, _ in licenses.RULES] + ["BSD-3-Clause,BSD-2-Clause", "BSD-2-Clause", "MIT", "CC0-1.0"]
    docs = spark.createDataFrame(
        [(i, "\n".join(sentence(x) for x in ids)) for i, ids in enumerate(rows)], "doc_id long, text string"
    )
    got = licenses.scan(docs).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == want
    assert [r.n_licenses for r in got] == [len(x.split(",")) for x in want]
    # what stood on both sides of taken identifiers does not meet
    rules = (("B", ("cc0",)), ("A", ("bsd-redistribution", "bsd-source")))
    assert [r.licenses for r in licenses.scan(docs, rules=rules).where(f"doc_id = {len(rows) - 1}").collect()] == ["B"]
    assert {r.licenses for r in licenses.scan(docs, rules=()).collect()} == {""}


BSD = [licenses.SENTENCES[x] for x in ("bsd-redistribution", "bsd-source", "bsd-binary")]


def test_whole_sentences_and_free_names(spark):
    core = " may be used to endorse or promote products derived from this software without specific prior written permission."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. {}."
    gpl2 = licenses.SENTENCES["gpl2-free"]
    cases = [
        (mpl.format("2.0"), "MPL-2.0"),
        (mpl.format("1.1"), ""),
        (mpl.format("2.0").replace("v. ", "v.\n# "), "MPL-2.0"),
        (mpl.format("2.0").replace("v. ", "v."), "MPL-2.0"),
        ("\n".join([*BSD, "Neither the name of the University nor the names of its contributors" + core]), "BSD-3-Clause"),
        ("\n".join([*BSD, "3. Neither the name of Foo Bar, Inc. nor the names of its contributors" + core]), "BSD-3-Clause"),
        ("\n".join([*BSD, "Neither the name of Foo" + core]), "BSD-3-Clause"),
        ("\n".join([*BSD, "The name of the author" + core.replace("may be", "may not be")]), "BSD-3-Clause"),
        ("\n".join([*BSD, "Provided as is."]), "BSD-2-Clause"),
        (textwrap.fill(gpl2, 40), "GPL-2.0-or-later"),
        (gpl2.replace("version 2 ", "version 9 "), ""),
        (licenses.SENTENCES["lgpl21-free"], "LGPL-2.1-or-later"),
        (licenses.SENTENCES["mpl-11"], "MPL-1.1"),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = [r.licenses for r in licenses.scan(docs).orderBy("doc_id").collect()]
    assert got == [want for _, want in cases]
