"""Declared languages and visible text, also of odd and hostile markup; rare languages are learned."""

import random
import time

import pytest

from runlens.llm import language_id

CASES = {
    '<html data-lang="fr" lang="de"><p>x': ("de", "x"),
    '<html xml:lang="fr" lang=de-AT>x': ("de", "x"),
    '<html xml:lang="fr">x': ("fr", "x"),
    '<!-- <html lang="fr"> --><html lang="de">x': ("de", "x"),
    '<HTML LANG=EN>x<html lang="fr">': ("en", "x"),
    '<p lang="fr">a<b>b</b> c</p>': ("", "a b c"),
    "<html lang><head><title>t</title></head><body>x<script>var a = '<p>'</script ><style>p{}</style>y": ("", "x y"),
    "<script>no end": ("", "no end"),
    "a < b <c": ("", "a < b <c"),
    '<html class="a>b" lang=es>x': ("es", "x"),
    "": ("", ""),
}


@pytest.mark.parametrize("page", CASES)
def test_declared_language_and_text(page):
    declared, text = language_id.read(page)
    assert (declared, " ".join(text.split())) == CASES[page]


@pytest.mark.parametrize("page", ["<script>" * 50000, "<" * 400000, "<a " * 200000, '<html lang="' * 50000 + ">", "<!--" * 100000, "<style><head>" * 40000 + ">"])
def test_hostile_markup_takes_linear_time(page):
    began = time.process_time()
    language_id.read(page)
    assert time.process_time() - began < 10


def test_a_rare_language_is_learned(spark):
    gen = random.Random(3)
    words = {"en": "the of and that this with from have been", "xx": "qoz vuk zyx wuqo kiv zaqo vyz"}
    rows = [(k, " ".join(gen.choices(words["en"].split(), k=30)), "en") for k in range(400)] + [(1000 + k, " ".join(gen.choices(words["xx"].split(), k=30)), "xx") for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, model = language_id.train(docs, sample=40)
    assert langs == ["en", "xx"] and model.shape[0] == 2
    pages = spark.createDataFrame([(1, "http://a.example/", f"<p>{words['xx']} {words['xx']}"), (2, "http://a.example/", f"<p>{words['en']} {words['en']}")], "page_id long, url string, html string")
    assert {r.page_id: r.lang for r in language_id.identify(pages, docs).collect()} == {1: "xx", 2: "en"}
