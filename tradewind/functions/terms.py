"""Minimum orders, lead times and mixed loads read from suppliers' lines.

Text is read by a lexicon of trade words and rules over it. What was read has its place, so
that a name can be given without the terms in it; what could not be read is reported.
"""

from __future__ import annotations

from tradewind.functions.lexicon import HIT, Lexicon, mapped
from tradewind.functions.spans import found, name_without
from tradewind.functions.sqltext import S, Sql, let, on_columns

# The words of suppliers' lines, and what they mean.
CURRENCIES = {
    "EUR": ["€", "eur", "euro", "euros"],
    "GBP": ["£", "gbp", "pound", "pounds", "sterling"],
    "USD": ["$", "usd", "dollar", "dollars"],
    "AED": ["aed"],
    "SGD": ["sgd"],
    "CHF": ["chf"],
    "PLN": ["pln"],
    "CZK": ["czk"],
    "RON": ["ron"],
    "DKK": ["dkk"],
    "SEK": ["sek"],
    "NOK": ["nok"],
}
SUPPORTED = ["EUR", "USD", "GBP", "AED", "SGD"]
UNITS = {
    "Cases": ["case", "cases", "cs"],
    "Cartons": ["carton", "cartons", "ctn", "ctns", "box", "boxes"],
    "Bottles": ["bottle", "bottles", "btl", "btls"],
    "Pieces": ["piece", "pieces", "pc", "pcs", "unit", "units", "each", "ea"],
    "Pallets": ["pallet", "pallets", "plt", "plts", "pal", "pals"],
}
MOQ_TYPES = ["Order Value", "Cases", "Cartons", "Bottles", "Pieces", "Pallets", "Container", "Full Truckload", "No Minimum", "Applies — Unspecified"]
#: Days in a unit of time; a working day is seven fifths of a day.
DURATIONS = {
    1.0: ["day", "days"],
    7.0: ["week", "weeks", "wk", "wks"],
    30.0: ["month", "months", "mth", "mths", "mo", "mos"],
    1 / 24: ["hour", "hours", "hr", "hrs", "h"],
}

_all = lambda table: [w for words in table.values() for w in words]
WORDS = Lexicon(
    currency=_all(CURRENCIES), unit=_all(UNITS), pallet=UNITS["Pallets"], time=_all(DURATIONS), day=DURATIONS[1.0], hour_h=["h"],
    scale=["k", "m"], dash=["-", "–", "—"], to=["to", "~"], plus=["+"], colon=[":", "="], dot=["."], slash=["/"], times=["x", "×"],
    break_=["\n", "|", ";", "•"], zero=["0"], feet=["ft", "feet", "'", "’"], high=["hc", "hq"], sizes=["20", "40"],
    full=["full", "complete"], truck=["truck"], load=["load", "loads"], truckload=["ftl", "truckload", "truckloads", "fulltruckload", "fulltruckloads", "fullload", "fullloads"],
    container=["fcl", "container", "containers", "cntr", "cntrs"], multiple=["quantity", "quantities", "multiples", "load", "loads"],
    moq=["moq"], minimum=["minimum"], min=["min"], m=["m"], o=["o"], q=["q"],
    order=["order", "purchase", "shipment", "invoice"], plain_order=["order"], amount=["quantity", "qty", "value", "amount"], mixed_word=["mixed"],
    no=["no"], nothing=["none", "nil", "na"], n=["n"], a=["a"], any_=["any"], quantity=["quantity"],
    applies=["applies", "apply", "applicable", "yes"], subject=["subject"],
    working=["working", "business", "work"], same=["same"], next=["next"], overnight=["overnight"],
    out=["out"], of=["of"], not_=["not", "no"], stock=["stock"], ex=["ex"], in_=["in"], on=["on"], the=["the"], floor=["floor"],
    prompt=["immediate", "immediately", "prompt"], available=["available"], readily=["readily", "directly", "direct"], now=["now", "immediately"],
    ready=["ready"], for_=["for"], ship=["ship", "load"], collect=["collection", "loading", "pickup"],
    lead=["lead"], time_word=["time"], leadtime=["leadtime"], delivery=["delivery"], dispatch=["dispatch", "dispatched"], shipping=["shipping", "loading", "production"],
    shipped=["ship", "shipped", "shipment"], within=["in", "within"], other_lead=["collection", "eta", "availability"],
    mix=["mix", "mixing"], allowed=["allowed", "possible", "permitted", "ok", "available"], can=["can"], be=["be"], cannot=["cannot", "cant"], apostrophe=["'", "’"], t=["t"],
    flexible=["flexible"], variant=["variant", "variants"], assorted=["assorted"], partial=["partial"], multi=["multi", "multibrand"], brand=["brand"],
    single=["single"], sku=["sku", "variant", "brand"], only=["only"], unmixed=["unmixed"], mixed_any=["mix", "mixing", "mixed", "mixes"],
)

_AMOUNT = "(number scale?)"
_NAMED = "(minimum order? amount? | order minimum | moq | m dot o dot q dot? )"
_RULES = {
    "keyword": f"({_NAMED} | minimum mixed_word order | min (?= (colon|dash|dot)? (order|amount|mixed_word|number|currency)))",
    "none": "(no (minimum order? amount? | min | moq | order minimum) | (moq|minimum plain_order?) (colon|dash)? (nothing | no | n slash? a | zero) | any_ quantity)",
    "applies": "((moq|minimum plain_order?) (colon|dash)? applies | subject to a? (moq|minimum))",
    "money": f"(currency {_AMOUNT} | {_AMOUNT} currency)",
    "count": f"{_AMOUNT} (dash|to)? {_AMOUNT}? full? unit",
    "truck": "(number times?)? (truckload | full? truck load | full load)",
    "container": "(number times?)? (sizes feet high? | container)",
    "pallets": "(full pallet | pallet multiple)",
    "first": "^ (colon|dash)? number",
    "last": "number $",
    "duration": "(number (dash|to|plus)? number? (working? time))",
    "same": "same dash? day",
    "next": "(next dash? day | overnight)",
    "gone": "(not_ in_? stock | out of stock)",
    "stock": "(ex dash? stock | in_ stock | on the? floor | prompt | readily available | available now | ready (now | to ship | for_ collect) | stock available)",
    "lead": "(lead dash? time_word | leadtime | delivery | dispatch | shipping time_word | shipped within | ready in_ | available in_ | other_lead)",
    "whole_stock": "^ (ready | (in_ | ex dash?)? stock | on the? floor | prompt | available now?) dot? $",
    "unmixable": "(no mixed_any | not_ mixed_word | (cannot | can apostrophe t) be mixed_word | unmixed only | full pallet only | single sku only)",
    "mixable": "(mixed_word | can be mixed_word | mix allowed | flexible variant | partial (quantity|amount|pallet) allowed | assorted | multi dash? brand?)",
}


#: Letters without which a text cannot hold what a reader looks for: most texts go no further.
_SPEAKS = {
    "keyword": r"(?i)moq|m\s*\.\s*o|min|any",
    "lead": "(?i)lead|deliver|dispatch|ship|loading|production|ready|avail|collection|eta|stock|floor|prompt|immediate|readily|direct",
    "mixed": "(?i)mix|flexible|partial|assorted|multi|full|single",
}


def _hits(tokens: Sql, rule: str) -> Sql:
    return WORDS.hits(tokens, _RULES[rule])


def _says(tokens: Sql, rule: str) -> Sql:
    return WORDS.says(tokens, _RULES[rule])


def _first(tokens: Sql, rule: str) -> Sql:
    return S.get(_hits(tokens, rule), S.lit(0))


def _spaced(text: Sql) -> Sql:
    """35 000 as 35,000: places stay the same."""
    return S.regexp_replace(S.coalesce(text, S.lit("")), r"(?<=[0-9])\s(?=[0-9]{3}(?![\p{L}0-9_]))", ",")


def amount_of(text: Sql) -> Sql:
    """35k, 1.5m, 35.000 and 35,000.50 as numbers: three digits after the last separator are
    thousands. Without a number, null."""

    def read(t: Sql) -> Sql:
        digits = S.regexp_extract(t, "[0-9][0-9.,]*", 0)
        cut = S.regexp_replace(digits, "[.,](?=.*[.,])", "")
        plain = S.when(digits.rlike(r"[.,][0-9]{3}\z"), S.regexp_replace(digits, "[.,]", "")).otherwise(S.replace(cut, ",", "."))
        return plain.try_cast("double") * S.when(S.endswith(t, "k"), 1000).when(S.endswith(t, "m"), 1000000).otherwise(1)

    return let(S.lower(text), read)


def _quantity(parts: Sql, nth: int = 0) -> Sql:
    number, scale = WORDS.pick(parts, "number", nth), WORDS.pick(parts, "scale")
    return amount_of(S.concat(number, S.coalesce(S.lower(scale), S.lit(""))))


def money(tokens: Sql) -> Sql:
    """array<struct<amount, start, end, currency>> of all amounts of money above zero."""
    each = S.transform(_hits(tokens, "money"), lambda h: S.struct(_quantity(h["parts"]).alias("amount"), h["start"].alias("start"), h["end"].alias("end"), mapped(WORDS.pick(h["parts"], "currency"), CURRENCIES).alias("currency")))
    return S.filter(each, lambda m: m["amount"] > 0)


def counts(tokens: Sql) -> Sql:
    """array<struct<qty, start, end, type>> of all counts above zero; a range counts as its lower end."""
    each = S.transform(_hits(tokens, "count"), lambda h: S.struct(S.floor(_quantity(h["parts"]) + 0.5).cast("double").alias("qty"), h["start"].alias("start"), h["end"].alias("end"), mapped(WORDS.pick(h["parts"], "unit"), UNITS).alias("type")))
    return S.filter(each, lambda c: c["qty"] > 0)


def durations(tokens: Sql) -> Sql:
    """array<struct<days, start, end>>; a range counts as its upper end, rounded up to days."""
    times = {str(days): words for days, words in DURATIONS.items()}

    def one(h: Sql) -> Sql:
        n = S.coalesce(_quantity(h["parts"], 1), _quantity(h["parts"]))
        worked = WORDS.pick(h["parts"], "working").isNotNull() & WORDS.pick(h["parts"], "day").isNotNull()
        days = n * mapped(WORDS.pick(h["parts"], "time"), times).cast("double") * S.when(worked, 1.4).otherwise(1)
        return S.struct(S.ceil(S.round(days, 6)).cast("int").alias("days"), h["start"].alias("start"), h["end"].alias("end"))

    return S.transform(_hits(tokens, "duration"), one)


def _term(kind: Sql | str, qty: Sql | None = None, currency: Sql | str = "", note: Sql | str = "", bare: Sql | None = None, at: Sql | None = None) -> Sql:
    lit = lambda x: x if isinstance(x, Sql) else S.lit(x)
    none = S.lit(None)
    return S.struct(
        lit(kind).alias("type"), (none if qty is None else qty).cast("double").alias("qty"), lit(currency).alias("currency"), lit(note).alias("note"),
        (none if bare is None else bare).cast("double").alias("bare"), (none if at is None else at["start"]).cast("int").alias("start"), (none if at is None else at["end"]).cast("int").alias("end"),
    )


BOTH = "Both an order value and a unit count were stated as the minimum; the order value was taken"
SEVERAL = "More than one minimum unit was stated; the first one was taken"
UNSPECIFIED = "Applies — Unspecified"


def _refused(currency: Sql) -> Sql:
    return S.concat(S.lit("The minimum is stated in "), currency, S.lit(", which MOQ Currency has no option for — the amount was read but not published"))


def _value(text: Sql, at_end: bool = False) -> Sql:
    """The minimum that a stretch of text states: none, money, counts, loads, or a bare number."""

    def read(f: Sql) -> Sql:
        least = S.array_min(f["money"])
        unit = S.get(f["counts"], S.lit(0))["type"]
        same = S.filter(f["counts"], lambda c: c["type"] == unit)
        count = S.array_min(same)
        number = lambda h: WORDS.pick(S.when(S.size(h["parts"]) > 1, h["parts"]), "number").try_cast("double")
        value = S.when(f["none"].isNotNull(), _term("No Minimum", at=f["none"]))
        value = value.when(least["currency"].isin(SUPPORTED), _term("Order Value", least["amount"], least["currency"], S.when(S.size(f["counts"]) > 0, BOTH).otherwise(""), at=least))
        value = value.when(least.isNotNull(), _term(UNSPECIFIED, note=_refused(least["currency"]), at=least))
        value = value.when(count.isNotNull(), _term(unit, count["qty"], note=S.when(S.size(f["counts"]) > S.size(same), SEVERAL).otherwise(""), at=count))
        value = value.when(f["truck"].isNotNull(), _term("Full Truckload", number(f["truck"]), at=f["truck"]))
        value = value.when(f["container"].isNotNull(), _term("Container", S.when(~S.contains(S.lit(WORDS.classes["sizes"]), S.get(f["container"]["parts"], S.lit(0))["kind"]) | S.contains(S.lit(WORDS.classes["times"]), S.coalesce(S.get(f["container"]["parts"], S.lit(1))["kind"], S.lit("?"))), number(f["container"])), at=f["container"]))
        value = value.when(f["pallets"].isNotNull(), _term("Pallets", S.when(WORDS.pick(f["pallets"]["parts"], "full").isNotNull(), 1), at=f["pallets"]))
        bare = S.floor(_quantity(f["bare"]["parts"]) + 0.5)
        return value.when(bare > 0, _term(UNSPECIFIED, bare=bare, at=f["bare"]))

    def parts(t: Sql) -> Sql:
        single = [_first(t, r).alias(r) for r in ("none", "truck", "container", "pallets")]
        return let(S.struct(money(t).alias("money"), counts(t).alias("counts"), _first(t, "last" if at_end else "first").alias("bare"), *single), read)

    return let(WORDS.told(text), parts)


def _moved(term: Sql, start: Sql, end: Sql) -> Sql:
    return S.when(term.isNotNull(), S.struct(*(term[c].alias(c) for c in ("type", "qty", "currency", "note", "bare")), start.cast("int").alias("start"), end.cast("int").alias("end")))


def _segments(text: Sql) -> Sql:
    """Stretches that no value reaches across: lines, and parts between |, ; and bullets."""
    return S.filter(found(text, r"[^\n|;•]+"), lambda s: S.trim(s["value"]) != "")


def _announced(segment: Sql) -> Sql:
    """The minimum in free text: behind the word that announces one, else before it."""

    def read(t: Sql) -> Sql:
        def around(w: Sql) -> Sql:
            text = segment["value"]
            behind = _value(S.substring(text, w["key"]["end"] + 1, S.length(text)))
            before = _value(S.left(text, w["key"]["start"]), at_end=True)

            def choose(v: Sql) -> Sql:
                at, key = segment["start"], w["key"]
                none = _moved(_term("No Minimum"), at + w["none"]["start"], at + w["none"]["end"])
                told = S.when(w["none"].isNotNull(), none).when(key.isNull(), None)
                told = told.when(v["behind"].isNotNull(), _moved(v["behind"], at + key["start"], at + key["end"] + v["behind"]["end"]))
                told = told.when(v["before"].isNotNull(), _moved(v["before"], at + v["before"]["start"], at + key["end"]))
                return told.when(w["applies"].isNotNull(), _moved(_term(UNSPECIFIED), at + key["start"], at + key["end"]))

            return let(S.struct(behind.alias("behind"), before.alias("before")), choose)

        return let(S.struct(*(_first(t, r).alias(r) for r in ("keyword", "none", "applies"))).cast(_AROUND), around)

    return let(WORDS.told(segment["value"]), read)


_AROUND = f"struct<key:{HIT},none:{HIT},applies:{HIT}>"


@on_columns
def minimum_order(text: Sql, cell: bool = False) -> Sql:
    """struct<type, qty, currency, note, bare, start, end> or null.

    Money before counts, counts before loads; of several the least. A currency that no field
    can hold is recognised and refused, so that no later rule takes its number. `bare` is a
    number without a unit. In free text the first segment that announces a minimum and
    states one is read; `cell` is a column of its own, read whole.
    """
    whole = _spaced(text)
    if not cell:
        told = S.get(S.filter(S.transform(_segments(whole), _announced), lambda v: v.isNotNull()), 0)
        return S.when(whole.rlike(_SPEAKS["keyword"]), told)

    def read(t: Sql) -> Sql:
        def choose(k: Sql) -> Sql:
            label = k["key"]["first"] == 0
            rest = S.when(label, S.regexp_replace(S.substring(whole, k["key"]["end"] + 1, S.length(whole)), r"\A\s*[:=\-]?\s*", ""))
            said = S.coalesce(_value(whole), _value(rest), S.when(k["applies"].isNotNull() | k["key"].isNotNull(), _term(UNSPECIFIED)))
            return let(said, lambda v: _moved(v, S.lit(0), S.length(whole)))

        return let(S.struct(*(_first(t, r).alias(r) for r in ("keyword", "none", "applies"))).cast(_AROUND), choose)

    return S.when(S.trim(whole) != "", let(WORDS.told(whole), read))


def _lead_value(t: Sql) -> Sql:
    """struct<days, start, end>: the longest duration, else same or next day, else in stock."""

    def read(f: Sql) -> Sql:
        longest = S.array_max(S.transform(f["durations"], lambda d: S.struct(d["days"].alias("days"), (-d["start"]).alias("s"), d["end"].alias("end"))))
        fixed = lambda days, h: S.struct(S.lit(days).alias("days"), h["start"].alias("start"), h["end"].alias("end"))
        value = S.when(longest.isNotNull(), S.struct(longest["days"].alias("days"), (-longest["s"]).alias("start"), longest["end"].alias("end")))
        value = value.when(f["same"].isNotNull(), fixed(0, f["same"])).when(f["next"].isNotNull(), fixed(1, f["next"]))
        return value.when(f["gone"].isNotNull(), None).when(f["stock"].isNotNull(), fixed(0, f["stock"]))

    return let(S.struct(durations(t).alias("durations"), *(_first(t, r).alias(r) for r in ("same", "next", "gone", "stock"))), read)


@on_columns
def lead_time(text: Sql, cell: bool = False) -> Sql:
    """struct<days, start, end> or null; 0 is ex stock, not silence.

    A duration beats an availability, a range counts as its upper end, working days as seven
    fifths. In free text the first segment that speaks of delivery or stock and states a
    time is read; a cell may also say only that it is ready.
    """
    whole = S.coalesce(text, S.lit(""))
    if cell:
        ready = lambda t: S.coalesce(_lead_value(t), S.when(_says(t, "whole_stock"), S.struct(S.lit(0).alias("days"), S.lit(0).alias("start"), S.length(whole).alias("end"))))
        return S.when(S.trim(whole) != "", let(WORDS.told(whole), ready))

    def segment(s: Sql) -> Sql:
        def read(t: Sql) -> Sql:
            def choose(w: Sql) -> Sql:
                start = S.least(w["lead"]["start"], w["value"]["start"])
                end = S.greatest(w["lead"]["end"], w["value"]["end"])
                told = S.struct(w["value"]["days"].alias("days"), (s["start"] + start).alias("start"), (s["start"] + end).alias("end"))
                return S.when(w["value"].isNotNull() & (w["lead"].isNotNull() | w["stock"].isNotNull()), told)

            return let(S.struct(_first(t, "lead").alias("lead"), _first(t, "stock").alias("stock"), _lead_value(t).alias("value")), choose)

        return let(WORDS.told(s["value"]), read)

    told = S.get(S.filter(S.transform(_segments(whole), segment), lambda v: v.isNotNull()), 0)
    return S.when(whole.rlike(_SPEAKS["lead"]), told)


@on_columns
def lead_days(text: Sql) -> Sql:
    return lead_time(text, cell=True)["days"]


@on_columns
def mixed_load(text: Sql) -> Sql:
    """False beats true; silence is null."""
    tokens = WORDS.told(S.coalesce(text, S.lit("")))
    said = let(tokens, lambda t: S.when(_says(t, "unmixable"), False).when(_says(t, "mixable"), True))
    return S.when(text.rlike(_SPEAKS["mixed"]), said)


@on_columns
def keyword_window(text: Sql, rule: str) -> Sql:
    """The segment with a word that announces something, for a report; null without one."""
    said = S.filter(_segments(_spaced(text)), lambda s: _says(WORDS.told(s["value"]), rule))
    return S.when(text.rlike(_SPEAKS[rule]), _clipped(S.get(said, 0)["value"]))


def _clipped(text: Sql) -> Sql:
    return S.left(S.trim(S.regexp_replace(text, r"\s+", " ")), S.lit(120))


@on_columns
def supplier_default(qty: Sql, unit: Sql, days: Sql) -> Sql:
    """struct<type, qty, days> of a supplier's record: units by name or by word, quantities
    above zero, days of zero or more; what does not fit is null."""
    names = {t: [t.lower()] for t in MOQ_TYPES}
    word = S.trim(S.coalesce(unit, S.lit("")))
    kind = S.coalesce(mapped(word, names), mapped(word, UNITS))
    whole = lambda x: S.floor(x.try_cast("double") + 0.5)
    n, d = whole(qty), whole(days)
    return S.struct(kind.alias("type"), S.when(n > 0, n).cast("double").alias("qty"), S.when(d >= 0, d).cast("int").alias("days"))


BORROWED = "Quantity %s was stated without a unit; the supplier's default unit (%s) was used"
BARE = '"%s" was stated as a minimum with no unit — MOQ Qty left blank rather than guessed'
FROM_HEADER = ["MOQ taken from the list header", "Lead time taken from the list header"]
MOVED = "Operational terms were moved out of the product name"


def _whole(x: Sql) -> Sql:
    return x.cast("long").cast("string")


@on_columns
def cascade(name: Sql, moq: Sql, notes: Sql, read: Sql, header: Sql, default: Sql) -> Sql:
    """The terms of a line from what was read of it: own column, name, notes, header, default.
    read: struct<moq_cell, moq_name, moq_notes, lead_cell, lead_name, lead_notes, mixed>."""

    def resolve(r: Sql) -> Sql:
        own, lead = r["moq"], r["lead"]
        kind = default["type"]
        borrows = (own["type"] == UNSPECIFIED) & own["bare"].isNotNull() & kind.isNotNull()
        bare = own["bare"].isNotNull() & kind.isNull()
        by_cell, by_name, by_notes = (read[f"moq_{k}"].isNotNull() for k in ("cell", "name", "notes"))
        lead_cell, lead_name, lead_notes = (read[f"lead_{k}"].isNotNull() for k in ("cell", "name", "notes"))
        moq_type = S.when(borrows, kind).when(own.isNotNull(), own["type"]).otherwise(kind)
        days = S.coalesce(lead["days"], default["days"])
        at = lambda v: S.struct(v["start"].alias("start"), v["end"].alias("end"))
        spans = S.array_compact(S.array(S.when(~by_cell & by_name, at(read["moq_name"])), S.when(~lead_cell & lead_name, at(read["lead_name"]))))
        said = S.array(
            S.when(own.isNotNull() & ~by_cell & ~by_name & ~by_notes, FROM_HEADER[0]),
            S.when(lead.isNotNull() & ~lead_cell & ~lead_name & ~lead_notes, FROM_HEADER[1]),
            S.when(borrows, S.format_string(BORROWED, _whole(own["bare"]), kind)),
            S.when(bare, S.format_string(BARE, _whole(own["bare"]))),
            S.nullif(own["note"], ""),
        )
        stated = S.when(by_cell, _clipped(moq)).when(by_name, read["window_name"]).when(by_notes, read["window_notes"])
        return S.struct(
            spans.alias("spans"),
            moq_type.alias("moq_type"),
            S.when(borrows, own["bare"]).when(own.isNotNull(), own["qty"]).when(kind.isNotNull(), default["qty"]).alias("moq_qty"),
            S.when(moq_type == "Order Value", own["currency"]).otherwise("").alias("moq_currency"),
            S.when(by_cell, "Supplier Stated").when(own.isNotNull(), "Parsed From Text").when(kind.isNotNull(), "Supplier Default").otherwise("").alias("moq_source"),
            S.coalesce(read["mixed"], header["mixed"]).alias("mixed_load"),
            days.alias("lead_days"),
            S.when(lead_cell, "Supplier Stated").when(lead.isNotNull(), "Parsed From Text").when(days.isNotNull(), "Supplier Default").otherwise("").alias("lead_source"),
            S.array_compact(said).alias("notes"),
            S.when(bare | S.startswith(own["note"], "The minimum is stated in"), stated).alias("refused"),
        )

    first = S.struct(
        S.coalesce(read["moq_cell"], read["moq_name"], read["moq_notes"], header["moq"]).alias("moq"),
        S.coalesce(read["lead_cell"], read["lead_name"], read["lead_notes"], header["lead"]).alias("lead"),
    )
    return let(first, resolve)


@on_columns
def unread(moq: Sql, lead: Sql, read: Sql, terms: Sql) -> Sql:
    """Parts of a line that announce a term which could not be read."""
    no_moq, no_lead = read["moq_cell"].isNull(), read["lead_cell"].isNull()
    parts = S.array(
        S.when(no_moq & (moq != ""), _clipped(moq)),
        S.when(no_moq & read["moq_name"].isNull(), read["window_name"]),
        S.when(no_moq & read["moq_name"].isNull() & read["moq_notes"].isNull(), read["window_notes"]),
        S.when(no_lead & (lead != ""), _clipped(lead)),
        S.when(no_lead & read["lead_name"].isNull(), read["lead_window_name"]),
        S.when(no_lead & read["lead_name"].isNull() & read["lead_notes"].isNull(), read["lead_window_notes"]),
        S.nullif(terms["refused"], ""),
    )
    return S.array_compact(parts)


@on_columns
def cleaned_name(name: Sql, spans: Sql) -> Sql:
    return name_without(name, spans)


@on_columns
def header_terms(header: Sql) -> Sql:
    """struct<moq, lead, mixed> of a list's header."""
    return S.struct(minimum_order(header).alias("moq"), lead_time(header).alias("lead"), mixed_load(header).alias("mixed"))
