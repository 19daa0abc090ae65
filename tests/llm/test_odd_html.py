"""Pages as crawlers find them: what is wrong in the markup costs no text."""

from __future__ import annotations

import pytest

from tallyflow.llm import warc_derivatives


def text_and_fields(html, media="text/html; charset=utf-8"):
    record = warc_derivatives.response_record(1, "u", html, "2024-01-01T00:00:00Z")
    if media != "text/html; charset=utf-8":
        payload = f"HTTP/1.1 200 OK\r\nContent-Type: {media}\r\n\r\n{html}".encode()
        record = warc_derivatives.serialised([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("Content-Length", str(len(payload)))], payload)
    rows = {r[1]: r[9] for r in warc_derivatives.derivatives(record)}
    return rows["conversion"], rows["metadata"]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a<![ if IE]>b<![ endif]>c", "abc"), ("<p>x<![foo[bar]]>y", "xy"), ("a<![>b", "ab"), ("a<![if !IE]>b<![endif]>c", "abc"),
        ("a<![CDATA[x > y]]>b", "ab"), ("a<![", "a<!["), ("a&#" + "9" * 5000 + ";b", "a�b"), ("a&#" + "0" * 5000 + "66;c", "aBc"),
    ],
)
def test_markup_that_the_parser_does_not_know(html, want):
    assert text_and_fields(html)[0] == want


def test_encodings_that_are_not_for_text():
    assert text_and_fields("<p>a", "text/html; charset=idna")[0] == text_and_fields("<p>a", "text/html; charset=base64")[0] == "a"


@pytest.mark.parametrize(
    "html, want",
    [
        ("<html><head><title>T</title><p>Hello", "Hello"), ("<head><title>T</title> Hello<b> you", "Hello you"),
        ("<head><meta charset=utf-8><style>x{}</style>\n<script>y</script><title>T</title><div>a<p>b", "a\nb"),
        ("<head><title>T</title><noscript><p>js</p></noscript><p>Hello", "Hello"), ("<head><title>T</title><noscript><p>Hello", "Hello"),
        ("<title>T</title><p>a<template><p>Hello", "a\nHello"), ("<title>T</title><p>a<template>x<noscript>y</noscript>z</template>b", "ab"),
        ("<head><title>T</title><noscript>n</head><body>Hello", "Hello"), ("<head><noscript>n<title>T</title><body>Hello", "Hello"),
        ("<head><title>T</title></head><p>a<noscript>n<p>m</noscript>b", "a\nb"), ("<title>T</title><p>a<template>x<noscript>y</template>b<script>z", "ab"),
    ],
)
def test_heads_and_hidden_parts_that_are_not_closed(html, want):
    text, fields = text_and_fields(html)
    assert text == want and "title: T\r\n" in fields
