import pytest

from quillmeter.pricing.catalog import Catalog, Route, Version, built_in, merge, observe, read_cache, to_ms, verify, write_cache
from quillmeter.pricing.pages import page_versions, parse_page
from quillmeter.pricing.spans import priced

EVENTS = "model string, timestamp_ms long, input_tokens long, cached_input_tokens long, cache_write_input_tokens long, output_tokens long, total_tokens long"


def cost(spark, *rows, catalog=None):
    data = [(m, to_ms(t) if isinstance(t, str) else t, i, c, w, o, i + o) for m, t, i, c, w, o in rows]
    return priced(spark.createDataFrame(data, EVENTS), spark, catalog or built_in()).collect()


def test_literals(spark):
    r = cost(
        spark,
        ("gpt-5.6-sol", "2026-07-30", 250_000, 25_000, 50_000, 100_000),
        ("gpt-5.6-terra", "2026-07-30", 300_000, 100_000, 50_000, 100_000),
        ("gpt-6-astra", "2026-09-03", 300_000, 100_000, 50_000, 100_000),
        ("gpt-5.6-luna", "2026-07-22", 1000, 200, 300, 100),
        (" GPT-5.6 ", "2026-07-30", 250_000, 25_000, 50_000, 100_000),
        ("gpt-5.4", "2026-05-01", 100_000, 0, 0, 0),
    )
    assert [round(x.estimated_cost_usd, 12) for x in r] == [4.2, 2.69, 11.95, 0.001495, 4.2, 0.25]
    assert [x.provisional_priced_requests for x in r] == [0, 0, 0, 0, 0, 1]


def test_assumed_prices_follow_the_route(spark):
    r = cost(spark, ("codex-auto-review", "2026-07-22", 100_000, 0, 0, 10_000), ("codex-auto-review", "2026-07-30", 100_000, 0, 0, 10_000))
    assert [(round(x.assumed_cost_usd, 12), round(x.assumed_upper_bound_cost_usd, 12), x.estimated_cost_usd) for x in r] == [(0.4, 0.8, 0), (0.032, 0.8, 0)]


def test_starts_are_inclusive_and_unknown_times_unpriced(spark):
    start = to_ms("2026-09-22")
    r = cost(spark, ("gpt-6-sol", start - 1, 1000, 0, 0, 0), ("gpt-6-sol", start, 1000, 0, 0, 0), ("gpt-6-sol", None, 1000, 0, 0, 0), ("other", start, 1, 0, 0, 0))
    assert [x.priced_requests for x in r] == [0, 1, 0, 0] and [x.unpriced_total_tokens for x in r] == [1000, 0, 1000, 1]


@pytest.mark.parametrize(("tokens", "usd"), [(271_999, 5), (272_000, 5), (272_001, 10)])
def test_long_rates_begin_above_the_threshold(spark, tokens, usd):
    (r,) = cost(spark, ("gpt-5.6-sol", "2026-08-01", tokens, 0, 0, 0))
    assert round(r.estimated_cost_usd, 9) == round(tokens * usd / 1e6, 9)


def test_ties_and_supersession():
    v = lambda id_, start, rate, **k: Version(id_, to_ms(start), False, rate, 1, **k)
    c = Catalog({"m": [v("a", "2024-01-01", 1), v("b", "2024-01-01", 2), v("c", "2024-02-01", 3, superseded_by="b"), v("x", None, 8, observed_ms=5), v("y", None, 9, observed_ms=5)]}, routes={"r": [Route("one", 5, "m", "m"), Route("two", 5, "m", "m")]})
    assert c.price("m", to_ms("2024-03-01")).id == "b" and c.price("m", 0).id == "y" and c.price("m", None).id == "b"
    assert c.route("r", 5).id == "one" and c.route("r", 4) is None


@pytest.mark.parametrize("bad", [{"input": 0}, {"output": float("inf")}, {"long": (1, None, None, 1)}, {"threshold": 5}, {"input": True}])
def test_invalid_versions(bad):
    with pytest.raises(ValueError):
        Version(**({"id": "v", "effective_ms": None, "provisional": True, "input": 1, "output": 1} | bad))


def test_json_round_trip_and_flat_schema():
    c = built_in()
    assert Catalog.from_json(c.to_json()).digest() == c.digest()
    old = Catalog.from_json({"models": {"M": {"input": 1, "output": 2}}})
    assert old.models["m"][0].provisional and old.models["m"][0].id == "m-legacy"
    with pytest.raises(ValueError):
        Catalog.from_json({"schemaVersion": 9, "models": {}})


PAGE = """# Falcon

A model for tests. | Context | 1M tokens |

| Model ID | `falcon` |

## Limits

| Input | $7 | 1M tokens |

## Pricing

Prices are in dollars.

### Images

| Input | $8 | 1M tokens |

### Text tokens

| Kind | Dollars | For |
| --- | --- | --- |
| Input | $0.1 | 1M tokens |
| Output | $30 | 1M tokens |
| Cached input | $0.01 | 1M tokens |
| Output | $3 | image |

For cache writes, 3x the input rate applies. Above that, nothing.

Requests with > 272,000 input tokens cost 2x input and 1.5x output.

### Batches

| Input | $9 | 1M tokens |
"""


@pytest.mark.parametrize(
    ("sentence", "long", "threshold"),
    [
        ("With >128K tokens, input and cache rates double and output costs 1.5 times as much.", (0.2, 0.02, 0.6, 45), 128_000),
        ("Above >1M tokens input tokens are priced at 3x, output tokens at 2×.", (0.3, 0.03, 0.9, 60), 1_000_000),
        ("Prompts with >5k tokens are 2x input.", None, None),
    ],
)
def test_long_context_sentences(sentence, long, threshold):
    v = parse_page(PAGE.replace("Requests with > 272,000 input tokens cost 2x input and 1.5x output.", sentence), "falcon")
    assert (v.long, v.threshold) == (long, threshold)


def test_only_the_same_page_is_completed():
    formal = Version("f", 5, False, 1, 2, 0.1, 1.5, (2, 0.2, 3, 4), 100, content_hash="a")
    seen = lambda **k: Version(**({"id": "s", "effective_ms": 9, "provisional": True, "input": 1, "output": 2, "cached": 0.1, "write": 1.5, "long": (2, 0.2, 3, 4), "threshold": 100, "content_hash": "a"} | k))
    for version, over in ((seen(), True), (seen(content_hash="b"), True), (seen(long=None, threshold=None), True), (seen(long=None, threshold=None, content_hash="b"), False), (seen(write=None, long=(2, 0.2, None, 4)), True), (seen(write=None, long=None, threshold=None), False), (seen(write=None, cached=None), False), (seen(write=1.4), False), (seen(effective_ms=4), False)):
        merged = merge(Catalog({"m": [formal]}), Catalog({"m": [version]}))
        assert (merged.models["m"][1].superseded_by == "f") == over


def test_pages(spark):
    v = parse_page(PAGE, "Falcon")
    assert v.rates() == (0.1, 0.01, 0.3, 30, (0.2, 0.02, 0.6, 45), 272_000)
    with pytest.raises(ValueError, match="mismatch"):
        parse_page(PAGE, "n")
    with pytest.raises(ValueError):
        parse_page("# no page", "falcon")
    rows = page_versions(spark.createDataFrame([(" Falcon", PAGE), ("n", PAGE), (None, PAGE), ("falcon", None)], "model string, markdown string")).collect()
    assert tuple(rows[0]) == ("falcon", 0.1, 0.01, 0.3, 30.0, 0.2, 0.02, 0.6, 45.0, 272_000, v.content_hash, None)
    assert all(r.input is None and r.error for r in rows[1:]) and "mismatch" in rows[1].error


def test_observe_verify_merge(tmp_path):
    c, v, now = Catalog(), parse_page(PAGE, "falcon"), to_ms("2024-05-01")
    seen = observe(c, "m", v, now)
    assert seen.provisional and seen.effective_ms == now and observe(c, "m", v, now + 1) is None
    new, changed = verify(c, "m", v, "2024-04-01", "https://example.org/p", now)
    assert changed and not new.provisional and c.models["m"][0].superseded_by == new.id
    assert verify(c, "m", v, "2024-04-01", "https://example.org/p", now)[1] is False
    with pytest.raises(ValueError):
        verify(c, "m", v, "April", "https://example.org", now)
    seed = Catalog({"m": [new]})
    runtime = Catalog()
    observe(runtime, "m", v, now)
    merged = merge(seed, runtime)
    assert [x.superseded_by for x in merged.models["m"]] == [None, new.id]
    path = str(tmp_path / "cache.json")
    write_cache(path, merged)
    assert read_cache(path).digest() == merged.digest()
    (tmp_path / "cache.json").write_text("{")
    assert read_cache(path) is None and [p for p in tmp_path.iterdir() if ".corrupt-" in p.name]


def test_announcements_replace_what_was_seen_and_other_prices_of_the_day():
    price = lambda n, **k: Version(**({"id": "x", "effective_ms": None, "provisional": True, "input": n, "output": 2 * n} | k))
    c, day = Catalog(), to_ms("2024-04-01")
    observe(c, " M ", price(1), 10)
    observe(c, "m", price(2), 20)
    assert observe(c, "m", price(2), 30) is None and observe(c, "m", price(1), 40) is not None
    first, _ = verify(c, "m", price(3), "2024-04-01", "https://example.org/a", 50)
    second, changed = verify(c, "m", price(2, content_hash="0123456789"), "2024-04-01", "https://example.org/a", 60)
    assert changed and second.effective_ms == day and len({v.id for v in c.models["m"]}) == 5
    assert [v.superseded_by for v in c.models["m"]] == [None, second.id, None, second.id, None]
    assert verify(c, "m", price(2), "2024-04-01", "https://example.org/a", 70) == (second, False)
    # The other catalog's own announcements do not decide over what it saw; equal undated prices come once.
    seed, other = Catalog({"m": [price(5, id="base")]}, checked_at="2024-01-01"), Catalog({"m": [price(5, id="again"), price(6, id="seen", effective_ms=9), price(6, id="told", effective_ms=1, provisional=False)]}, checked_at="2024-02-01")
    merged = merge(seed, other)
    assert [(v.id, v.superseded_by) for v in merged.models["m"]] == [("base", None), ("seen", None), ("told", None)]
    assert merged.checked_at == "2024-02-01" and len(seed.models["m"]) == 1 and merge(seed, None) is seed


def test_metadata():
    m = built_in().metadata()
    assert m["longContextThresholdTokens"] == 272_000 and "gpt-5.6" in m["pricedModels"] and m["assumedModels"][0]["assumedModel"] == "gpt-5.6-luna"
