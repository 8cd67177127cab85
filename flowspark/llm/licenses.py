"""Licence scans: Aho-Corasick over words, and licence expressions (operator 8)."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.common import table, utf8, words

# Fixed values of the contract: phrase, label.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Phrases of the method's own, of common notices and identifiers: phrase, label.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by-notice",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
    "permission is hereby granted free of charge": "mit-notice",
}
TAG = "spdx license identifier"
_TAGGED = re.compile(rb"spdx-license-identifier[ \t]*[:=][ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}
# How much a licence asks for, by the beginning of its identifier; others count as 2.
_DUTIES = {"mit": 0, "bsd": 0, "isc": 0, "apache": 0, "cc0": 0, "unlicense": 0, "mpl": 1, "lgpl": 1, "gpl": 2, "agpl": 2}
_CLASSES = ("permissive", "weak-copyleft", "copyleft")


def evaluate(expression):
    """Identifiers of a licence expression and the duties that it leaves, or None if it is
    not one. `and` asks for both sides' duties, `or` for the lighter side's, and `with`
    lowers copyleft by its exception. Shunting-yard: any length and depth, in one pass."""
    values, operators, ids = [], [], []

    def apply():
        name = operators.pop()
        right, left = values.pop(), values.pop()
        values.append({"or": min, "and": max}[name](left, right) if name != "with" else min(left, 1))

    wanted = True  # an operand comes next
    for token in _TOKEN.findall(expression):
        name = token.lower()
        if wanted and token == "(":
            operators.append(token)
        elif wanted and name not in _RANK and token != ")":
            ids.append(name)
            duties = next((d for k, d in _DUTIES.items() if name.startswith(k)), 2)
            values.append(duties)
            wanted = False
        elif not wanted and name in _RANK:
            while operators and operators[-1] != "(" and _RANK[operators[-1]] >= _RANK[name]:
                apply()
            operators.append(name)
            wanted = True
        elif not wanted and token == ")":
            while operators and operators[-1] != "(":
                apply()
            if not operators:
                break  # the tag stands in brackets of its own: the expression is over
            operators.pop()
        elif wanted:
            return None
        else:
            break  # another word follows: the expression is over
    if wanted:
        return None
    while operators:
        if operators[-1] == "(":
            return None
        apply()
    return ids, values[0]


def scan(docs: DataFrame, base=None, notices=None, id_column="doc_id", text_column="text") -> DataFrame:
    """Licence phrases and tags of whole texts; one row per row of `docs`.

    Words are runs of digits, letters and characters outside ASCII. Columns: doc_id,
    n_words, n_base (all places of base phrases), first_word and last_word (of base places;
    null without any), base_labels, labels (with notices, and of valid tag expressions each
    identifier as `spdx-<id>` and the class), expressions (as found), score (0 without a
    finding, then growing with their number). Null and empty texts: no words. An invalid
    expression adds nothing but itself to `expressions`.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    base, notices = dict(BASE if base is None else base), dict(NOTICES if notices is None else notices)

    def find(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        # In Latin-1 each byte of a UTF-8 text is one character.
        for phrase in {**base, **notices, TAG: None}:
            key = f" {phrase.encode().decode('latin-1')} "
            automaton.add_word(key, (len(key), phrase))
        automaton.make_automaton()
        for batch in batches:
            rows = []
            for text in utf8(batch.column("text")):
                found = words(text)
                line = b" " + b" ".join(found) + b" "
                n, first, last, labels, own, tagged, noted = 0, None, None, set(), set(), False, 0
                places = []
                for end, (length, phrase) in automaton.iter(line.decode("latin-1")):
                    if phrase in base:
                        places.append(end - length + 1)
                        labels.add(base[phrase])
                    if phrase in notices:
                        own.add(notices[phrase])
                        noted += 1
                    tagged = tagged or phrase == TAG
                if places:
                    n = len(places)
                    first, last = line.count(b" ", 0, min(places)), line.count(b" ", 0, max(places))
                expressions = [e.decode() for e in _TAGGED.findall(text)] if tagged else []
                for value in filter(None, map(evaluate, expressions)):
                    own.update(f"spdx-{i}" for i in value[0])
                    own.add(_CLASSES[value[1]])
                score = 1 - 0.5 ** (n + noted + 2 * len(expressions))
                rows.append((len(found), n, first, last, ",".join(sorted(labels)),
                             ",".join(sorted(labels | own)), expressions, score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.string()), pa.float64()]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                 "expressions", "score"])

    return docs.mapInArrow(
        find, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, expressions array<string>, score double")


def op8_licenses(spark: SparkSession, sf_dir) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
