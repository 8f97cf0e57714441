"""Texts of numbers, items of few words, glued units: what is no copy, what is one, and how long it takes."""

import random
import time

import pyarrow as pa
import pytest

from spanloom.llm import decontaminate as D
from spanloom.llm.shingles import buffers


def found(text, items):
    data, offsets = buffers(pa.array([text], pa.large_string()))
    return {x[1]: x[4:] for x in D.find_in(data, offsets, D.build_block(list(range(len(items))), items), 0.8)}


def test_rows_of_numbers_are_no_copies_of_other_numbers():
    items = ["7 9 11 13 15", "2, 4, 6, 8, 10, 12", "42", "Yes", "What is it?"]
    assert found("Lottery: 4 8 15 16 23 42 and more words here today", items) == {}
    assert found("1 2 3 4 5 6", items) == {}
    assert found("Yes, what is it? It is a long text of other things, said 42 of them.", items) == {}


def test_numbers_with_their_values_and_short_texts_are_found():
    items = ["7 9 11 13 15", "2, 4, 6, 8, 10, 12", "42", "What is it?"]
    assert set(found("the row 2 4 6 8 10 12 stands here among other words of a text", items)) == {1}
    assert set(found("42", items)) == {2} and set(found("What is it? 42!", items)) == {3} and set(found("42 What", items)) == {2}


@pytest.mark.parametrize(
    ("text", "items"),
    [
        (" ".join(str(random.Random(1).randrange(1000) * i % 997) for i in range(250_000)), ["Compute the mean of the values 3, 7, 9, 12, 15, 21, 30 and explain the result", "1 2 3 4 5 6 7 8 9 10 11 12"]),
        (" ".join(f"row {i} has {i * 7 % 1000} units" for i in range(40_000)), ["row 3 has 17 units row 4 has 18 units row 5 has 3 units"]),
    ],
)
def test_a_megabyte_of_numbers_takes_no_time(text, items):
    began = time.time()
    found(text, items)
    assert len(text) > 900_000 and time.time() - began < 2


def test_units_glued_to_numbers_are_units():
    item = "A train goes 60 km in 2 h and then 30 km in 1 h. How far did it go in all?"
    assert found("A train goes 80km in 3h and then 20km in 1h. How far did it go in all?", [item])[0][0] == 8
    assert found(item, ["A train goes 80km in 3h and then 20km in 1h. How far did it go in all?"])[0][0] == 8
    tokens = D.templates(*buffers(pa.array(["5kg 3x 4km2 km 7 kg 1,5l 10k."], pa.large_string())))
    assert tokens.kinds.tolist() == [1, 2, 1, 1, 2, 1, 2, 1, 2, 1, 2]


def test_items_asked_again_with_other_numbers_and_names():
    """Of items asked again with other numbers, names and units, glued or not, nine tenths or more are found."""
    rng, hit = random.Random(4), 0
    names, units, things = ["Anna", "Tom", "Lucia", "Peter", "Maria"], ["km", "kg", "m", "h", "l"], ["apples", "books", "coins", "cards"]
    for _ in range(100):

        def ask(thing, verb):
            a, b = rng.sample(names, 2)
            u, glue = rng.choice(units), rng.choice(["", " "])
            return f"In the shop {a} {verb} {rng.randint(2, 90)} {thing} and gives {rng.randint(2, 90)} of them to {b}, who walks {rng.randint(2, 90)}{glue}{u} home. How many {thing} does {a} have left?"

        shape = rng.choice(things), rng.choice(["buys", "finds", "sells"])
        hit += 0 in found("Some words come first. " + ask(*shape) + " And some words follow.", [ask(*shape)])
    assert hit >= 90
