from marlstone.llm import page_diff


def test_differencing_judges_articles(spark):
    """A place that all articles of a host share goes, whatever it is called; a shared line at a place that varies stays.

    So do lines on hosts of few pages, and articles that are versions of each other.
    """
    outro = '<div class="outro-7"><p>Read more about how we work</p></div>'

    def page(k, body):
        return f"<body><nav>n</nav><article><h1>Title {k}</h1>{body}{outro}</article><footer>f {k}</footer></body>"

    pages, want = [], {}

    def add(url, html, *kept):
        want[len(pages)] = "\n\n".join(kept)
        pages.append((len(pages), url, html))

    for host, extra in (("a.x", 0), ("b.x", 1)):
        for k in range(150):  # more than one block of URLs
            add(f"http://{host}/{k:03d}", page(k, f"<p>own {host} {k}</p><p>He agreed.</p><p>more {k}</p>"), f"Title {k}", f"own {host} {k}", "He agreed.", f"more {k}")
        if extra:  # a page that marks no article: then all lines of the host are moved
            add(f"http://{host}/x", "<body><p>open</p></body>", "open")
    for k in range(3):
        add(f"http://few.x/{k}", page(k, f"<p>own {k}</p><p>more {k}</p>"), f"Title {k}", f"own {k}", f"more {k}", "Read more about how we work")
    for k in range(8):
        add(f"http://versions.x/{k}", page(k, "<p>one</p><p>two</p><p>three</p>"), f"Title {k}", "one", "two", "three", "Read more about how we work")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    assert {r["page_id"]: r["text"] for r in page_diff.extract(df).collect()} == want
    plain = {r["page_id"]: r["text"] for r in page_diff.extract(df, differencing=False).collect()}
    assert sum(plain[k] != want[k] for k in want) == 300
