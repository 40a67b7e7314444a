"""The gates and keywords of the license rules lose none of their detections."""

import random
import re
import time
from re import _constants as c
from re import _parser

import pytest

from palimpsest.llm import licenses


def drawn(parsed, rng):
    """A text that a parsed expression matches."""
    out = ""
    for op, arg in parsed:
        if op is c.LITERAL:
            out += chr(arg)
        elif op is c.IN:
            kind, value = rng.choice(arg)
            out += chr(value) if kind is c.LITERAL else "2"
        elif op is c.ANY:
            out += "x"
        elif op is c.BRANCH:
            out += drawn(rng.choice(arg[1]), rng)
        elif op is c.SUBPATTERN:
            out += drawn(arg[3], rng)
        else:
            assert op in (c.MAX_REPEAT, c.MIN_REPEAT)
            out += "".join(drawn(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
    return out


def plain_labels(text, rules):
    """Labels by all rules, tried on all texts."""
    padded = f" {' '.join(re.findall('[a-z0-9]+', text.lower()))} "
    found = [
        (padded.count(" ", 0, m.start()), padded.count(" ", 0, m.end()), priority, i, label)
        for i, (label, regex, priority) in enumerate(rules) for m in regex.finditer(padded)
    ]

    def over(y, x):
        return y[0] <= x[0] and y[1] >= x[1] and (y[2], y[1] - y[0], -y[3]) > (x[2], x[1] - x[0], -x[3])

    base = {label for phrase, label in licenses.BASE if f" {phrase} " in padded}
    return ",".join(sorted(base | {x[4] for x in found if not any(over(y, x) for y in found)}))


def test_every_rule_passes_the_gates(spark):
    rng = random.Random(5)
    rules = [(label, re.compile(f" (?:{regex})(?= )"), priority) for label, regex, _, priority, _ in licenses.rules()]
    texts = [f"so {drawn(_parser.parse(regex), rng)} it" for _, regex, *_ in licenses.rules() for _ in range(8)]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).select("doc_id", "labels").collect()
    assert len(rows) == len(texts)
    want = {i: plain_labels(t, rules) for i, t in enumerate(texts)}
    assert all(want.values())
    assert [(texts[r.doc_id], r.labels, want[r.doc_id]) for r in rows if r.labels != want[r.doc_id]] == []


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("See the GPL for details", "gpl"), ("Distributed subject to the GPL", "gpl"), ("Released subject to the Apache 2.0", "apache-2.0"), ("See the MIT file", "mit"), ("published by the ISC", "isc"),
        ("licensed under the 2-clause license", "bsd-2-clause"), ("see the sea for details, distributed by mail", ""),
    ],
)
def test_forms_without_a_gate_word(spark, text, labels):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == labels
