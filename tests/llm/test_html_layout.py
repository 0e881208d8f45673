"""Op 4 against a slow renderer that puts lines together level by level, and in shapes whose size must not cost its square."""

import random
import time

import pytest

from gridwise.llm import html_layout
from gridwise.llm.html_layout import EXACT, render


def random_list(r, depth):
    """(html, lines) of a list; lines are prefixed anew at each level."""
    ordered, start = r.random() < 0.5, r.choice([1, 9, 98])
    page, out = (f'<ol start="{start}">' if ordered else "<ul>"), []
    for k in range(r.randint(1, 3)):
        inner, lines = "", []
        for _ in range(r.randint(1, 3)):
            if depth and r.random() < 0.5:
                a, b = random_list(r, depth - 1)
            elif r.random() < 0.2:
                a, b = random_table(r)
            else:
                word = f"w{r.randrange(1000)}"
                a, b = f"<div>{word}</div>", [word]
            inner, lines = inner + a, lines + b
        marker = f"{start + k}. " if ordered else "- "
        page += f"<li>{inner}" + r.choice(["", "</li>"])
        out += [(marker if i == 0 else " " * len(marker)) + x if x else "" for i, x in enumerate(lines)]
    return page + ("</ol>" if ordered else "</ul>"), out


def random_table(r):
    rows = [[[f"c{r.randrange(10 ** r.randint(1, 6))}" for _ in range(r.randint(1, 3))] for _ in range(r.randint(1, 4))] for _ in range(r.randint(1, 3))]
    page = "<table>" + "".join("<tr>" + "".join("<td>" + "<br>".join(cell) for cell in row) for row in rows) + "</table>"
    n = max(len(row) for row in rows)
    width = [max((len(x) for row in rows if c < len(row) for x in row[c]), default=0) for c in range(n)]
    out = []
    for row in rows:
        for k in range(max(len(cell) for cell in row)):
            out.append("  ".join((cell[k] if k < len(cell) else "").ljust(width[c]) for c, cell in enumerate(row)).rstrip())
    return page, out


def test_lists_and_tables_equal_the_slow_renderer():
    r = random.Random(8)
    for _ in range(300):
        page, lines = random_list(r, 4)
        # Tables stand in gaps of their own; both sides are compared without blank lines.
        got = [x for x in render(page, EXACT).split("\n") if x]
        assert got == [x for x in lines if x]
        assert html_layout.flat([html_layout.Group("> ", ["a", "", "b"])], None) == ["> a", "", "  b"]


def shapes(n):
    cells = "".join(f"<td>{k}</td>" for k in range(n))
    return {
        "cells": f"<table><tr>{cells}</table>",
        "a cell of many lines": f"<table><tr>{cells}<td>{'<br>'.join('x' * n)}</td></table>",
        "items under blocks": "<ul>" + "<div>" * n + "<li>x</li>" * n,
        "quotes": "<blockquote>x " * n,
        "lists": "<ul><li>x" * n,
        "rowspans": "<table>" + "<tr><td rowspan=9>a</td><td>b</td></tr>" * n,
    }


@pytest.mark.parametrize("shape", sorted(shapes(1)))
def test_time_and_padding_in_proportion(shape):
    n, took = 10_000, []
    for size in (n, 4 * n):
        page = shapes(size)[shape]
        began = time.perf_counter()
        out = render(page)
        took.append(time.perf_counter() - began)
        assert len(out) < 50 * size
    assert took[1] < 10 * took[0] + 0.5  # 4 times in proportion, 16 by the square


def test_limits_are_parameters():
    page = f"<table><tr><td>{'a' * 150}<td>b<tr><td>c<td>d</table>"
    assert render(page, EXACT).split("\n")[1] == "c" + " " * 151 + "d"
    assert render(page).split("\n")[1] == "c  d"
    deep = "<blockquote>x " * 30
    assert render(deep, EXACT).split("\n")[-1] == " " * 60 + "x" and render(deep).split("\n")[-1] == " " * 40 + "x"
