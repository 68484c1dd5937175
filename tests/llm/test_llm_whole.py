"""Training-data operators on what a cut would lose."""

import random
import re
import textwrap
import time

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from lociwave.llm import bpe, langid, licences


def blocks(text, size):
    """Plain version: each line with the next ones of its sentence until these hold size words, and all runs of size words."""
    word = lambda x: re.findall(licences.WORD, x)
    for sentence in re.split(licences.SENTENCE_END, text.lower()):
        cut = [w for x in sentence.split("\n") if (w := word(x))]
        for i, first in enumerate(cut):
            own, n = set(first), 0
            for x in cut[i + 1 :]:
                if n >= size:
                    break
                own, n = own | set(x), n + len(x)
            yield own
    found = word(text.lower())
    yield from (set(found[i : i + size]) for i in range(len(found)))


def plain(text):
    found = {}
    for label, template in licences.TEMPLATES.items():
        tokens = set(template.split())
        share = max((len(tokens & b) / len(tokens) for b in blocks(text, len(template.split()))), default=0)
        if share >= licences.THRESHOLD - 1e-9:
            found[label] = share
    return found


def test_wrapped_licences(spark):
    rng = random.Random(5)
    data = []
    for label, template in licences.TEMPLATES.items():
        for width in (12, 30, 72):
            for mark in ("", " * ", "# "):
                before = " ".join(rng.choice("lorem ipsum dolor the of a this".split()) for _ in range(rng.randrange(20)))
                notice = "\n".join(mark + x for x in textwrap.wrap(f"{before} {template} amet sit", width))
                data.append((len(data), label, f"Some text.\n\n{notice}\n\nMore of the text."))
    far = [(len(data) + i, None, x) for i, x in enumerate(("released\n" + "lorem ipsum\n" * 40 + "under the mit license", "under the\n\nmit of old", "", None))]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(data + far, "doc_id long, label string, text string")).collect()}
    for i, label, text in data + far:
        want = plain(text or "")
        base = {x for x in got[i].base_labels.split(",") if x}
        assert set(got[i].labels.split(",")) - {""} == base | set(want), text
        assert label is None or label in want
        assert base or abs(got[i].score - max(want.values(), default=0)) < 1e-12


def test_licence_words(spark):
    """The words of the pattern, of every ASCII character and beyond, at less than its cost."""
    every = "".join(f"{chr(c)}aZ{chr(c)}{chr(c)}9é" for c in range(128))
    texts = [every, every[::-1], "", None, " \x00\n", "\u212a\u0130İ ẞß Ǆ \U0001f600x", "x", " x ", "ÄÖ\u00a0\u2003A-B"]
    for row in spark.createDataFrame([(x,) for x in texts], "text string").select("text", licences.words(F.col("text")).alias("found")).collect():
        plain = re.sub("[A-Z]", lambda m: m.group().lower(), row.text or "")
        assert row.found == re.findall(licences.WORD, plain)

    rng = random.Random(8)
    many = spark.createDataFrame([(" ".join(rng.choice(("Lorem", "ipsum,", "größe", "the -", "of\n")) for _ in range(3000)),) for _ in range(200)], "text string")
    many = many.repartition(8).crossJoin(spark.range(6)).select("text").localCheckpoint()

    def seconds(found):
        def once():
            start = time.monotonic()
            many.select(F.sum(F.size(found))).collect()
            return time.monotonic() - start

        return min(once() for _ in range(2))

    assert seconds(licences.words(F.col("text"))) < 0.6 * seconds(F.regexp_extract_all("text", F.lit(licences.WORD), F.lit(0)))


def test_licence_over_a_sentence_end(spark):
    text = "You may not use this file except in compliance with the License.\nYou may obtain a copy of the License at"
    (row,) = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.labels == "apache-2.0-text" and row.score == 1.0


def test_licence_joins_no_other_sentence(spark):
    data = [(1, "Licensed under the Apache License, Version 2.0.\nDie Tinte in mit. Ein"), (2, "It is released under the terms of the MIT\nlicense.")]
    got = {r.doc_id: r.labels for r in licences.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: "apache-2.0", 2: "mit"}


def test_end_mark_in_a_text_is_text():
    for text in ("<|endoftext|>", "ä<|endoftext|><|endoftext|> b\n", "<|endof", "😀é <|endoftext|", " "):
        plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder(bpe.VOCABULARY)._mergeable_ranks, special_tokens={})
        assert bpe.encode_text(text).tolist() == plain.encode_ordinary(text)
        assert bpe.bytes_of(bpe.encode_text(text).tolist()) == text.encode()


def test_encoding_looks_for_no_empty_token():
    text = " information" * 20_000
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder(bpe.VOCABULARY)._mergeable_ranks, special_tokens={})

    def seconds(run):
        start = time.process_time()
        run(text)
        return time.process_time() - start

    assert min(seconds(bpe.encode_text) for _ in range(5)) < 0.8 * min(seconds(plain.encode_to_numpy) for _ in range(5))


def test_language_learns_each_text_once(spark):
    rng = random.Random(6)
    own = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(12))
    few, many = [own("abcde") for _ in range(40)], [own("vwxyz") for _ in range(40)]
    data = [(x, "a") for x in few] + [(few[0], "a")] * 4000 + [(x, "b") for x in many]
    model = langid.fit(spark.createDataFrame(data, "text string, lang string"), docs_per_language=60)
    plain = langid.fit(spark.createDataFrame([(x, "a") for x in few] + [(x, "b") for x in many], "text string, lang string"), docs_per_language=60)
    assert model.languages == plain.languages and all((a == b).all() for a, b in zip([*model.keys, *model.tables], [*plain.keys, *plain.tables], strict=True))
    few_only = langid.fit(spark.createDataFrame(data, "text string, lang string"), docs_per_language=7)
    assert few_only.languages == ["a", "b"] and 0 < len(few_only.keys[0]) < len(model.keys[0])


def test_boundaries_are_those_of_the_pattern():
    """Runs of kinds of characters give the ends of pre-tokens that the pattern gives, on texts of troublesome characters."""
    import random

    import public_tokenizers as P
    import regex

    from lociwave.llm import bpe

    pattern, draw = regex.compile(P.PATTERN), random.Random(5)
    letters = " \t\n\r   '''asltvedmrrevellLÉé中٣1²-_.,😀́\x1c\x1f\x85\xa0　​"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(20))) for _ in range(20_000)]
    texts += ["".join(chr(draw.choice([draw.randrange(0x3000), draw.randrange(0xE000, 0x110000), 32, 39, 115])) for _ in range(12)) for _ in range(2000)]
    for i, x in enumerate(texts):
        ends = [m.end() for m in pattern.finditer(x) if not x[m.end() - 1].isspace()]
        assert bpe.boundaries(x, True).tolist() == ends, repr(x)
        assert bpe.boundaries(x, False).tolist() == [e for e in ends if e <= len(x) - bpe.GUARD_CHARS], i
