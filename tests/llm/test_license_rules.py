"""Licence rules: each matches a text made from it, the prefilter changes nothing, suppression and base columns equal brute force."""

import random
import re
import time

import pytest

from gleaner.llm import license_scan as ls


def example(pattern, pick):
    """A text that the regex matches; `pick` chooses among alternatives."""
    import re._constants as c
    import re._parser as parser

    def of(items):
        out = ""
        for op, arg in items:
            if op is c.LITERAL:
                out += chr(arg)
            elif op is c.IN:
                out += next(" " if x == c.CATEGORY_SPACE else "1" if x == c.CATEGORY_DIGIT else "w" if kind is c.CATEGORY else chr(x if kind is c.LITERAL else x[0]) for kind, x in [pick([a for a in arg if a[0] is not c.NEGATE])])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
                out += "".join(of(arg[2]) for _ in range(max(arg[0], pick([arg[0], min(arg[1], arg[0] + 1)]))))
            elif op is c.SUBPATTERN:
                out += of(arg[3])
            elif op is c.BRANCH:
                out += of(pick(arg[1]))
            elif op is c.ANY:
                out += "x"
            elif op not in (c.ASSERT, c.ASSERT_NOT, c.AT):
                raise ValueError(op)
        return out

    return of(parser.parse(pattern))


def examples(seed):
    r = random.Random(seed)
    return [(rule, example(rule.regex.pattern, (lambda xs: xs[0]) if seed == 0 else r.choice)) for rule in ls.rules()]


def unfiltered(lower):
    """All matches without gates and keywords, suppressed by the definition."""
    hits = [(m.start(), m.end(), r) for r in ls.rules() for m in r.regex.finditer(lower)]
    outranks = lambda k, h: (-k[2].priority, k[0] - k[1], k[2].label) < (-h[2].priority, h[0] - h[1], h[2].label)
    kept = []
    for h in sorted(hits, key=lambda h: (-h[2].priority, h[0] - h[1], h[0], h[2].label)):
        if not any(k[0] <= h[0] and h[1] <= k[1] for k in kept):
            assert not any(outranks(h, k) and h[0] <= k[0] and k[1] <= h[1] for k in kept)
            kept.append(h)
    return sorted(kept, key=lambda h: (h[0], h[1], h[2].label))


def test_every_rule_matches_and_keywords_follow_from_it():
    assert len({r.regex.pattern for r in ls.rules()}) > 500 and len(ls.SIGNATURES.strip().split("\n")) > 180
    for seed in range(4):
        for rule, text in examples(seed):
            found = rule.regex.search(text)
            assert found, (rule.label, rule.regex.pattern, text)
            inside = re.sub(r"\s+", " ", found[0])
            assert rule.keyword in inside, (rule.keyword, inside)
            assert any(g in inside for g in ls.GATES), inside


def test_prefilter_and_suppression_change_nothing():
    r = random.Random(3)
    texts = [t for _, t in examples(1)]
    for _ in range(60):
        text = r.choice([" ", "\n", ". "]).join(r.choices(texts, k=r.randint(1, 6)))
        assert ls.detect(text) == unfiltered(text)
    rule = lambda p, label: ls.Rule(label, "", p, 1.0, re.compile(""))
    for _ in range(200):
        hits = [(s := r.randint(0, 20), s + r.randint(1, 9), rule(r.choice([1, 2, 3]), r.choice("ab"))) for _ in range(r.randint(0, 25))]
        want = []
        for h in sorted(hits, key=lambda h: (-h[2].priority, h[0] - h[1], h[0], h[2].label)):
            if not any(k[0] <= h[0] and h[1] <= k[1] for k in want):
                want.append(h)
        assert ls.suppressed(hits) == sorted(want, key=lambda h: (h[0], h[1], h[2].label))


def test_many_hits_in_one_text_take_linear_time():
    text = "Licensed under the MIT License. " * 8_000
    began = time.time()
    got = ls.scan(text)
    assert time.time() - began < 20 and (got["n_base"], got["first_word"], got["last_word"]) == (8_000, 3, 5 * 8_000 - 2)


def test_base_columns_equal_brute_force(spark):
    r = random.Random(9)
    parts = ["MIT", "License", "license,", "GENERAL", "public-license", "general public", "apache", "Apache License", "é", "x1", "ſ", "K", "mit\x00license", "\n", "42"]
    texts = [r.choice([" ", "", "-"]).join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(300)] + [None, "", "mit license " * 3000]
    got = {x.doc_id: x for x in ls.query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        base = [(k, label) for phrase, label in ls.PHRASES.items() for k in range(len(words)) if tuple(words[k:k + len(phrase)]) == phrase]
        x = got[i]
        assert (x.n_words, x.n_base) == (len(words), len(base))
        assert (x.first_word, x.last_word) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert x.base_labels == ",".join(sorted({b for _, b in base})) and set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(","))
        assert x.labels == ",".join(sorted({b for _, b in base} | {h[2].label for h in unfiltered(low)})) if i % 10 == 0 and len(low) < 9000 else True


@pytest.mark.parametrize("text,label", [("// SPDX-License-Identifier: MPL-2.0\n", "mpl-2.0"), ("// SPDX-License-Identifier: EPL-2.0\n", "epl-2.0"), ("// SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"),
                                        ("// SPDX-License-Identifier: AGPL-3.0-only", "agpl-3.0"), ("// SPDX-License-Identifier: GPL-2.0+", "gpl-2.0"), ("SPDX-License-Identifier: Python-2.0", "psf-2.0"),
                                        ("Released under the Mozilla Public License.", "mpl"), ("Available under the Eclipse Public License.", "epl"), ("Subject to the PHP license.", "php")])
def test_ids_and_names_without_version(text, label):
    assert ls.scan(text)["labels"] == label


def test_wrapped_clause_and_library_licence():
    assert "lgpl-2.0" in ls.scan("Released under the GNU Library General Public License, version 2.")["labels"].split(",")
    clause = f"Neither the name of {'the Very Long Holder ' * 9}\nnor the names of its\ncontributors may be used to endorse or\npromote products derived from this software"
    assert ls.scan(clause)["labels"] == "bsd-3-clause"


# Headers and notices as projects write them, none made from a rule.
HEADERS = [
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", {"mpl-2.0"}),
    ("Mozilla Public License, version 2.0", {"mpl-2.0"}), ("Eclipse Public License 2.0", {"epl-2.0"}), ("Boost Software License", {"bsl-1.0"}), ("GPLv3", {"gpl-3.0"}), ("Apache-2.0", {"apache-2.0"}),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", {"apache-2.0", "apache"}),
    ("Apache License 2.0", {"apache-2.0", "apache"}), ("GNU Affero General Public License version 3", {"agpl-3.0", "gpl"}), ("GNU Lesser General Public License version 3", {"lgpl-3.0", "gpl"}),
    ("dual licensed under MIT or Apache-2.0", {"mit", "apache-2.0"}), ("Dual-licensed under MIT or GPLv2.", {"mit", "gpl-2.0"}), ("Licensed under Apache 2.0 or the BSD 3-clause license", {"apache-2.0", "bsd-3-clause"}),
    ("distributed under the terms of the GNU General Public License, version 2", {"gpl-2.0", "gpl"}), ("This package is released under the Ruby License.", {"ruby"}), ("License: PHP\n", {"php"}), ("Python Software Foundation License", {"psf-2.0"}),
    ("European Union Public Licence", {"eupl-1.2"}), ("the SIL Open Font License", {"ofl-1.1"}), ("GPL-2.0-only", {"gpl-2.0"}), ("the 2-Clause BSD", {"bsd-2-clause"}),
]
NO_LICENCE = ["a python license to drive", "published under python", "a ruby license", "php license plates", "we serve pages with apache 2 on two hosts", "apache 2.4 was available under linux", "released under vim", "the boost software team", "openssl: license of fish", "mpl-2.1 and epl-2.5", "a common public place"]


@pytest.mark.parametrize("text,labels", HEADERS)
def test_headers_as_they_are_written(text, labels):
    assert set(ls.scan(text)["labels"].split(",")) == labels


@pytest.mark.parametrize("text", NO_LICENCE)
def test_texts_that_name_no_licence(text):
    assert ls.scan(text)["labels"] == ""
