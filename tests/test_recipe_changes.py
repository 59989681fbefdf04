"""Recipes written with their ingredients, against walking the feed one recipe at a time."""

import random

import pytest
import shop
from shop import frame, rows

from tallybook.operators.recipe_changes import insert_recipes, revise_recipes

FEED = "feed_id bigint, id bigint, name string, category string, prep_time int, instructions string"
LINES = "feed_id bigint, line_no int, product_id bigint, quantity decimal(10,2), unit string, notes string"


def random_feed(seed, count=25):
    rng = random.Random(seed)
    feed = [
        (k, rng.choice([1, 2, 3, 3, 77]), rng.choice(["Torta", "Caldo", "", None]), "Doces", rng.choice([5, 9, None]), "mexa")
        for k in rng.sample(range(100, 900), count)
    ]
    lines = [
        (k, n, rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 8, 99]), shop.Decimal(rng.randint(1, 9)), rng.choice(["kg", "un", "l", "g", "x", None]), None)
        for k, *_ in feed
        for n in range(rng.randint(0, 3))
    ]
    return feed, [*lines, (5, 1, 1, shop.Decimal(1), "kg", None)]


def reason(head, lines, unknown):
    if unknown:
        return "unknown:recipe"
    for name, value in (("name", head[2]), ("prep_time", head[4])):
        if value is None:
            return f"missing:{name}"
    for line in sorted(lines, key=lambda x: x[1]):
        if line[4] is None:
            return "missing:unit"
        if line[2] == 99:
            return "unknown:product_id"
    return None


def content(done):
    found = done.ingredients.select("id", "recipe_id", "product_id", "quantity", "unit")
    recipes = done.recipes.select("id", "name", "prep_time")
    return sorted(rows(recipes)), sorted(rows(found)), sorted(rows(done.rejected))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("write", [insert_recipes, revise_recipes])
def test_equals_one_recipe_at_a_time(spark, write, seed):
    feed, lines = random_feed(seed)
    base, used = shop.recipes(spark), shop.recipe_ingredients(spark)
    heads = frame(spark, FEED, feed)
    new = write is insert_recipes
    done = write(base, used, shop.products(spark), heads.drop("id") if new else heads, frame(spark, LINES, lines))

    recipes = {r["id"]: (r["name"], r["prep_time"]) for r in base.collect()}
    kept = [(r["id"], r["recipe_id"], r["product_id"], r["quantity"], r["unit"]) for r in used.collect()]
    rejected, added = [(5, "unknown:feed_id")], {}
    for head in sorted(feed):
        own = [x for x in lines if x[0] == head[0]]
        why = reason(head, own, not new and head[1] not in recipes)
        if why:
            rejected.append((head[0], why))
            continue
        at = max(recipes) + 1 if new else head[1]
        recipes[at] = (head[2], head[4])
        added[at] = sorted((at, *x[1:5]) for x in own)
        kept = [x for x in kept if x[1] != at]
    start = max(r["id"] for r in used.collect()) if new else max([x["id"] for x in used.collect()])
    flat = sorted(x for own in added.values() for x in own)
    numbered = [(start + 1 + n, r, p, q, u) for n, (r, _, p, q, u) in enumerate(flat)]
    got = content(done)
    assert got[0] == sorted((i, *x) for i, x in recipes.items())
    assert got[1] == sorted(kept + numbered)
    assert got[2] == sorted(rejected)


def test_nothing_to_write(spark):
    done = insert_recipes(
        shop.recipes(spark), shop.recipe_ingredients(spark), shop.products(spark),
        frame(spark, FEED, []), frame(spark, LINES, []), as_of=shop.AS_OF,
    )
    assert (done.recipes.count(), done.ingredients.count(), done.rejected.count()) == (3, 6, 0)


@pytest.mark.parametrize("write", [insert_recipes, revise_recipes])
def test_keys_of_a_long_feed_are_not_broadcast(spark, write):
    """However small the optimizer takes the written feed to be, its keys stay where they are."""
    feed, _ = random_feed(3)
    heads = frame(spark, FEED, [*feed, (None, 1, "Torta", "Doces", 5, "mexa")])
    lines = [(k, 1, 99, shop.Decimal(1), "kg", None) for k in (feed[0][0], 5, 5, None)]
    heads = heads.drop("id") if write is insert_recipes else heads
    done = write(
        shop.recipes(spark), shop.recipe_ingredients(spark), shop.products(spark), heads, frame(spark, LINES, lines)
    )
    plan = done.rejected._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    found = rows(done.rejected)
    assert [r for r in found if r[1] == "unknown:feed_id"].count((5, "unknown:feed_id")) == 1
    assert sorted(r[1] for r in found if r[0] is None) == ["missing:feed_id", "unknown:feed_id"]
