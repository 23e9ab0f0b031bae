"""Site templates do not depend on the size of their host."""

from runlens.llm import html_text


def test_a_block_on_five_pages_is_template_on_a_host_of_any_size(spark):
    block = '<div class="x1"><span>Part of the same site</span></div>'
    rows = [(k, "http://big.example/p", f"<body>{block if k < 5 else ''}{'<div>On four</div>' if 5 <= k < 9 else ''}<div>Text {k} is unlike</div></body>") for k in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {k: ("On four\n" if 5 <= k < 9 else "") + f"Text {k} is unlike" for k in range(600)}
    for broadcast in (1000, 0):
        assert {r.page_id: r.text for r in html_text.extract(pages, broadcast=broadcast).collect()} == want
