"""Cases of the second review."""

import numpy as np

import corpus_pipeline
from estatelens.llm.ann_forest import Forest, nearest
from estatelens.llm.dom import Page
from estatelens.llm.html_extract import extract, fit, labels, main_texts
from estatelens.llm.minhash import near_duplicates


def test_pipeline_masks_secrets_of_two_owners(spark, documents):
    key, shared, example = "9f8e7d6c5b4a" * 4, "0a9b8c7d6e5f" * 4, "31fe42dc53ba" * 4
    rows = [(i, f"token={key}", f"s{i}", "en") for i in range(4)]  # one text, copied to four owners
    rows += [(10 + i, f"text {i} token={shared}", f"s{i}", "en") for i in range(2)]
    rows += [(20 + i, f"text {i} token={example}", f"s{i}", "en") for i in range(3)]
    left = {r.doc_id: r.text for r in corpus_pipeline.secret_scan(spark, documents(rows), "").collect()}
    assert all(left[i] == "token=<secret>" for i in range(4))
    assert all(left[10 + i] == f"text {i} token=<secret>" for i in range(2))
    assert all(left[20 + i] == f"text {i} token={example}" for i in range(3))


def plain_page(number, dress):
    text = "".join(f"<p>Sentence {i} of page {number} tells, at some length, what happened on that day in town.</p>" for i in range(5))
    menu = "".join(f'<li><a href="/{i}">go {i}</a></li>' for i in range(6))
    return f"<html><body><div><ul>{menu}</ul></div><div{dress}><h1>Page {number}</h1>{text}</div><div><a href=/>imprint</a></div></body></html>"


def test_pages_without_article_keep_their_text(spark):
    rows = [(i, "u", plain_page(i, ["", ' class="content"'][i % 2])) for i in range(20)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:
        assert all(f"Sentence {i} of page {r.page_id} " in r.text for i in range(5))
        assert "go 1" not in r.text and "imprint" not in r.text


def test_unlabelled_pages_teach_nothing():
    articles = [plain_page(i, "").replace("<div><h1>", "<article><h1>").replace("</p></div>", "</p></article>") for i in range(60)]
    plain = [plain_page(100 + i, "") for i in range(60)]
    text = main_texts(fit(articles + plain), [plain[0]])[0]
    assert "Sentence 4 of page 100 " in text and "go 1" not in text


def test_comments_inside_an_article_are_no_main_text():
    page = Page('<article><p>text</p><div id="comments"><p>reply</p></div><div class="share-box">tell</div><p class="notice">n</p></article>')
    assert page.text_of(labels(page)) == "text"


def test_skipped_elements_end_where_they_end():
    def text(source):
        page = Page(source)
        return page.text_of([True] * len(page.tag))

    assert text("<p>a<svg width=1 /><p>b<svg><text>no</text></svg>c") == "a\n\nbc"
    assert text("<p>" + "\u0130" * 9 + "<script>x</SCRIPT >one<b>two</b>") == "\u0130" * 9 + "onetwo"
    assert text("<p>a <math><mi>x</mi></math> <object>b</object> <noscript>c</noscript><math/> d") == "a x b c d"


def test_every_text_of_an_id_counts(documents):
    own, copied = " ".join(f"own{i}" for i in range(60)), " ".join(f"same{i}" for i in range(60))
    rows = [(1, copied), (5, copied), (5, own), (7, f"{own} more"), (9, "else " * 3 + copied[::-1])]
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(rows)).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 9: 9}


def test_the_most_frequent_length_counts(spark):
    rows = [(i, [float(i % 7 + 1), 1.0]) for i in range(60)]
    for odd in range(100, 140):
        rows.append((odd, [1.0] * (odd - 90)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.query_id for r in nearest(df, df, k=3).collect()} == set(range(60))


def test_ties_in_a_leaf_go_to_smaller_ids(spark):
    rng = np.random.default_rng(0)
    grid = {tuple(x) for x in rng.integers(-3, 4, (600, 6)).tolist() if any(x)}
    rows = [(i, [1.0, *map(float, x)]) for i, x in enumerate(sorted(grid))]
    rows = [(i, v) for i, v in zip(rng.permutation(len(rows)).tolist(), [v for _, v in rows])]
    query = [(9999, [1.0] + [0.0] * 6)]  # the same score with every vector
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(rows + query, schema)
    got = nearest(df, df.where("vec_id = 9999"), k=5, forest=Forest(trees=2, share=3.0)).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [0, 1, 2, 3, 4]


def test_recall_beyond_the_least_rows(spark):
    matrix = np.random.default_rng(1).standard_normal((12_000, 32))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(matrix.tolist())], "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id % 200 = 0"), k=20).collect()
    hits = 0
    for query in range(0, 12_000, 200):
        scores = matrix @ matrix[query]
        scores[query] = -np.inf
        hits += len({r.vec_id for r in got if r.query_id == query} & set(np.argsort(-scores)[:20].tolist()))
    print("recall", hits / 1200)
    assert hits / 1200 >= 0.9
