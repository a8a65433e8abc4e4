"""Pages with broken tags, and vectors of very large and very small numbers."""

import time

import numpy as np
import pytest

from breakwater.llm import html_cut, neighbours, similar_text


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p>one <b title="a>b">two</b></p>', ["one two"]),
        ("<p>one <b title='a>b\">two</b>' x>three</b></p>", ["one three"]),
        ('<p>one <b title="a>two</b></p>', ["one two"]),
        ("<p>a < b, c <d> e</p>", ["a < b, c e"]),
        ('<p>text</p><a href="x', ["text"]),
        ("<p>text</p><!doc", ["text"]),
        ("<p>1<!-- <p>x --> 2<? x > 3</ y> 4</p>", ["1 2 3 4"]),
        ('<p a="1"b=\'2\'>quoted</p>', ["quoted"]),
    ],
)
def test_tags(page, want):
    assert [b.text for b in html_cut.blocks(page)[0]] == want


@pytest.mark.parametrize("piece", ['<a href="x', "<a href='x\"", '<a ">"', "<a ", "<", "<!", "</", "<a<", '<a "x" ', "\"<a '", "<a '\">'", "<a \">'\">"])
def test_work_grows_with_the_page(piece):
    for tail in ("", ">", '">', "'>", "<p>end</p>"):
        page = piece * (2_000_000 // len(piece)) + tail
        began = time.process_time()
        html_cut.Tags(page)
        tags, at, n = html_cut.Tags(page), 0, 0
        while tag := tags.following(at):
            at, n = tag[1], n + 1
        assert time.process_time() - began < 5, (piece, tail, n)


@pytest.mark.parametrize(("queries", "others"), [(1e-170, 1.0), (1e140, 1.0), (1.0, 1e-170), (1e-150, 1e-150), (1e150, 1e140), (1e-300, 1.0)])
def test_scales(spark, queries, others):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 12))
    x[::20] *= queries
    x[np.arange(600) % 20 != 0] *= others
    x[5:600:40] *= 1e-5  # among the others some much smaller
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(table).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for q in range(0, 600, 20):
        score = np.zeros(600)
        for j in range(12):
            score += x[q, j] * x[:, j]
        order = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:20]
        assert [got[q][k] for k in range(1, 21)] == order


def test_rows_that_leave_and_change_nothing():
    run = np.repeat([0, 10, 20, 30, 40], [5, 5, 4, 4, 3])
    label = np.array([1, 1, 1, 2, 2, 1, 1, 1, 2, 2, 1, 1, 2, 2, 3, 3, 4, 5, 6, 6, 7])
    kept = np.array([1, 1, 1, 1, 0, 0, 1, 0, 1, 1, 1, 0, 1, 1, 1, 1, 0, 0, 1, 0, 1], bool)
    hubs = np.zeros(21, bool)
    # three to two rows stay three to one; three to two become one to two; two and two become one and two; two single groups leave; two to one become equal
    assert similar_text._changed(run, label, kept, hubs).tolist() == [10, 20, 40]
    hubs[4] = True
    assert similar_text._changed(run, label, kept, hubs).tolist() == [0, 10, 20, 40]
