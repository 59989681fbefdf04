"""What the intake must come to, worked out one sale at a time."""

from __future__ import annotations

from decimal import Decimal

from tallybook.functions.text import fold_text

PREFIX = {"whatsapp": "WAT", "ifood": "IFO", "balcao": "BAL"}


def allocate(orders, items, stock, strict=False):
    """({feed_id: accepted}, shortages) in arrival order; ``stock`` is changed in place."""
    lines = {}
    for feed_id, product, quantity in items:
        lines.setdefault(feed_id, []).append((product, quantity))
    verdicts, shortages = {}, []
    for feed_id, _ in sorted(orders, key=lambda o: (o[1], o[0])):
        mine = lines.get(feed_id, [])
        asked = {}
        for product, quantity in mine:
            asked[product] = asked.get(product, 0) + quantity if strict else max(asked.get(product, 0), quantity)
        verdicts[feed_id] = all(stock[p] >= q for p, q in asked.items())
        if verdicts[feed_id]:
            for product, quantity in mine:
                stock[product] -= quantity
        else:
            lacking = asked.items() if strict else mine
            shortages += [(feed_id, p, stock[p], q) for p, q in lacking if q > stock[p]]
    return verdicts, shortages


def intake(feed, lines, stock, customers, last_numbers, year):
    """Take in valid sales: ({feed_id: (number, customer, total)}, new customers)."""
    verdicts, _ = allocate([(f["feed_id"], f["arrival_seq"]) for f in feed], [x[:3] for x in lines], stock)
    known, created, taken = {}, [], {}
    for i, name in sorted(customers):
        known.setdefault(fold_text(name.rstrip(" ")), i)
    next_customer = max((i for i, _ in customers), default=0) + 1
    for sale in sorted(feed, key=lambda f: f["arrival_seq"]):
        if not verdicts[sale["feed_id"]]:
            continue
        prefix = PREFIX[sale["channel"].lower()]
        last_numbers[prefix] = last_numbers.get(prefix, 0) + 1
        name = fold_text(sale["customer"].rstrip(" "))
        if name not in known:
            known[name] = next_customer
            created.append((next_customer, sale["customer"]))
            next_customer += 1
        total = sum((Decimal(q) * p for f, _, q, p in lines if f == sale["feed_id"]), Decimal(0))
        taken[sale["feed_id"]] = (f"{prefix}-{year}-{last_numbers[prefix]:04d}", known[name], total)
    return taken, created
