"""Offers in chat messages: prices, product names, quantities and terms, by rules over words."""

from __future__ import annotations

from tradewind.functions.lexicon import Lexicon, mapped
from tradewind.functions.spans import without
from tradewind.functions.sqltext import S, Sql, let, on_columns

# The words of suppliers' and buyers' messages.
PRICE_CURRENCIES = ["€", "£", "$", "eur", "euro", "euros", "usd", "gbp", "aed", "sgd"]
PRICE_UNITS = ["btl", "bottle", "bottles", "btls", "cs", "case", "cases", "ctn", "carton", "pc", "pcs", "piece", "pieces", "pack", "can", "jar", "unit", "units"]
CASES = ["case", "cases", "cs", "ctn", "ctns", "carton", "cartons"]
QUANTITY_UNITS = [*CASES, "btl", "btls", "bottle", "bottles", "pcs", "piece", "pieces", "pal", "pallet", "pallets", "unit", "units"]
ITEM_UNITS = ["unit", "units", "pcs", "piece", "pieces", "btl", "btls", "bottle", "bottles", "can", "cans"]
VOLUMES = ["ml", "cl", "dl", "ltr", "l", "cc", "g", "gr", "gm", "kg"]
INCOTERMS = {"EXW": ["exw", "exworks"], "FCA": ["fca"], "FOB": ["fob"], "CFR": ["cfr", "cnf"], "CIF": ["cif"], "DAP": ["dap"], "DDP": ["ddp"]}
WAREHOUSE_ALIASES = {"Loendersloot": ["loen", "loendersloot"]}
WAREHOUSES = ["Loendersloot", "NL", "Dubai", "Poland", "Riga", "Spain", "Vietnam", "Greece", "Indonesia", "Czech", "NewCorp", "Vergèze", "Bergamo"]
TERM_LABELS = ["price", "offer", "moq", "qty", "quantity", "stock", "terms", "payment", "packaging", "available", "lead", "delivery", "bbd", "ean", "origin", "packing"]

#: Each place has a set of its own, so that the letters of a text tell which ones it names. Names of
#: sets have no digits.
_PLACE = "place"
WORDS = Lexicon(
    currency=PRICE_CURRENCIES, price_unit=PRICE_UNITS, case_unit=CASES, quantity_unit=QUANTITY_UNITS, item_unit=ITEM_UNITS, volume=VOLUMES,
    box=["case", "ctn", "carton", "box"], pallet=["pallet"], incoterm=[w for words in INCOTERMS.values() for w in words],
    depot=[w.lower() for w in WAREHOUSES] + ["loen"], **{f"{_PLACE}{'_' * k}": WAREHOUSE_ALIASES.get(w, [w.lower()]) for k, w in enumerate(WAREHOUSES)}, label=TERM_LABELS,
    slash=["/"], per=["per"], dash=["-", "–", "—"], to=["to"], times=["x", "×"], colon=[":"], equals=["="], dot=["."], apostrophe=["'", "’"], question=["?"],
    a=["a"], in_=["in"], of=["of"], or_=["or"], number_word=["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"],
    ftl=["ftl", "fulltruck", "fulltruckload"], full=["full"], truck=["truck"], load=["load", "loads", "truckload", "truckloads"],
    ex=["ex"], works=["work", "works"], bonded=["bonded"], duty=["duty"], paid=["paid"],
    lead=["lead"], time=["time"], leadtime=["leadtime"], span=["day", "days", "week", "weeks", "month", "months"], approx=["approx", "approximately"],
    moq=["moq"], minimum=["minimum"], order=["order"], packing=["packing"], ean=["ean"],
    stop=["moq", "price", "prices", "terms", "warehouse", "incoterm", "delivery", "payment", "deposit", "balance", "available"],
    contact=["tel", "fax", "mob", "mobile", "phone", "email", "mail", "web", "www", "http", "contact", "regards", "thanks", "br"], e=["e"],
    attribute=["bbd", "expiry", "exp", "ean", "barcode", "moq", "price", "prices", "available", "availability", "stock", "qty", "quantity"], best=["best"], before=["before"],
    inexact=["average", "approx", "approximately", "around", "about", "starting", "from", "~"],
    we=["we"], are=["are"], have=["have"], offer=["offer"], offering=["offering"], for_=["for"],
    i=["i"], d=["d"], like=["like"], quote=["quote", "quotes", "quotation", "quotations"], price=["price"], send=["send", "share"], person=["me", "us"], your=["a", "your"], your_=["your"],
    what=["what"], whats=["whats"], s=["s"], can=["can"], you=["you"], beat=["do", "beat", "match"], looking=["looking"], buy=["buy"], buying=["buying"],
    interested=["interested"], want=["want"], request=["request", "requesting"],
)

_PRICE = "((currency number | number currency | number slash price_unit) ((slash | per) price_unit)?)"
_LOADS = "(full? truck? load)"
_RULES = {
    "price": _PRICE,
    "range": f"({_PRICE} (dash | to) currency? number (?! quantity_unit | price_unit))",
    "size": "(number volume | number (times | slash) number)",
    "boilerplate": "^ (contact | e dash contact)",
    "attribute": "^ (attribute | best before | lead dash? time | leadtime) (colon | dash)? number",
    "inexact": "inexact",
    "question": "question $",
    "quantity": f"^ (ftl | full truck load? | (number+ | number_word) (quantity_unit | {_LOADS}))",
    "terms": "^ (incoterm | ex works)",
    "announced": "((we are)? offering for_? | we offer | we have | offer for_) colon?",
    "incoterm": "(incoterm | ex dash? works)",
    "depot": "depot",
    "ex_depot": "(ex depot)",
    "several": "((incoterm | ex works) any{0,6}? or_)",
    "duty_paid": "(duty dash? paid)",
    "bonded": "bonded",
    "lead_label": "(lead dash? time | leadtime) (colon | dash)? (approx dot?)?",
    "lead_first": "^ number (dash | to)? number? span",
    "lead_before": "number (dash | to) number span (?= lead dash? time | leadtime)",
    "moq_label": "(moq (colon | dash)?)",
    "minimum_label": "(minimum order? (colon | dash)? (?= number))",
    "stop": "(stop | lead dash? time | leadtime)",
    "per_pallet": "(number+ case_unit (per | slash | a) pallet)",
    "stock": "(number+ case_unit (?! (per | slash | a) pallet))",
    "per_case": "(number item_unit (per | slash | in_ a) box)",
    "packing": "(packing of? number item_unit)",
    "ean": "(ean (colon | dash)? number)",
    "buyer": (
        "(i apostrophe? d like a? (quote | price) | send person? your? (quote | best price) | (what apostrophe? s | whats) your_ best price | can you beat"
        " | looking to buy | interested in_ buying | want to buy | request a? quote)"
    ),
}


#: Letters without which a text cannot hold what a rule looks for: most texts go no further.
_SPEAKS = {
    "price": "(?i)[€£$/]|eur|usd|gbp|aed|sgd",
    "size": "[0-9]",
    "quantity": "(?i)^\\s*(?:[0-9]|f|one|two|three|four|five|six|seven|eight|nine|ten)",
    "terms": "(?i)^\\s*[efcd]",
    "announced": "(?i)offer|we",
    "several": "(?i)(?<!\\p{L})or(?!\\p{L})",
    "lead_label": "(?i)lead",
    "lead_first": "(?i)^[0-9].*(?:day|week|month)",
    "lead_before": "(?i)lead",
    "moq_label": "(?i)moq",
    "minimum_label": "(?i)minimum",
}


def _hits(text: Sql, rule: str) -> Sql:
    """A rule's hits in a text of its own; none, without a look at its words, in most texts."""
    return S.when(text.rlike(_SPEAKS[rule]) if rule in _SPEAKS else text.isNotNull(), WORDS.hits(WORDS.told(text), _RULES[rule])).otherwise(S.array())


def _any(tokens: Sql, rule: str) -> Sql:
    return WORDS.says(tokens, _RULES[rule])


def _says(text: Sql, rule: str) -> Sql:
    """Whether a rule has a hit in a text of its own; false for null."""
    return S.coalesce(text.rlike(_SPEAKS[rule]) & _any(WORDS.told(text), rule), S.lit(False))


def _priced(line: Sql, hits: Sql) -> Sql:
    def one(h: Sql) -> Sql:
        token = S.substring(line, h["start"] + 1, h["end"] - h["start"])
        return S.struct(h["start"].alias("start"), h["end"].alias("end"), S.regexp_replace(token, "(?i)\\s*(?<![a-z])per\\s+", "/").alias("token"))

    return S.transform(hits, one)


@on_columns
def clean(text: Sql) -> Sql:
    """A message without zero-width characters, pictographs and markdown; dirhams as AED."""
    out = S.coalesce(text, "")
    for pattern, by in (
        ("\\r|[\\u200B-\\u200D\\uFEFF]", ""),
        ("[\\u2190-\\u21FF\\u2600-\\u27BF\\u2B00-\\u2BFF\\uFE0F\\u20E3\\x{1F000}-\\x{1FAFF}]", " "),
        ("[*_~`]+", " "),
        ("(?i)(?<![A-Za-z0-9_])dh?s(?![A-Za-z0-9_])", "AED"),
        ("[ \\t]+", " "),
    ):
        out = S.regexp_replace(out, pattern, by)
    return out


@on_columns
def lines_of(text: Sql) -> Sql:
    return S.filter(S.transform(S.split(text, "\\n", -1), lambda x: S.trim(x)), lambda x: x != "")


@on_columns
def prices(text: Sql) -> Sql:
    """array<struct<start, end, token>> of all prices; "2 EUR per pcs" reads "2 EUR/pcs"."""

    return let(text, lambda t: _priced(t, _hits(t, "price")))


@on_columns
def is_supplier_offer(text: Sql) -> Sql:
    """Has a price and is not written by a buyer."""
    return let(WORDS.told(S.coalesce(text, "")), lambda t: _any(t, "price") & ~_any(t, "buyer"))


@on_columns
def without_prices(text: Sql) -> Sql:
    """A line without its prices, and without the marks and labels that led to them."""
    return let(text, lambda t: _bare(t, _hits(t, "price")))


def _bare(text: Sql, prices: Sql) -> Sql:
    bare = S.trim(S.regexp_replace(without(text, prices), "\\s+", " "))
    # What may stand between a name and a price, in any order and number.
    bare = S.regexp_replace(bare, "(?i)(?:[\\s\\-–—@|,;]|(?:(?<![a-z0-9_])prices?)?\\s*:)+\\z", "")
    return S.trim(S.regexp_replace(bare, "\\A[\\s\\-–—@|]+", ""))


@on_columns
def read_line(line: Sql) -> Sql:
    """struct of what is needed of a line: prices, head, tail, flags, its letters, and how many
    of these end with the first price. A line's tokens are told here and nowhere else."""

    def read(t: Sql) -> Sql:
        def finish(found: Sql) -> Sql:
            p, first = found["prices"], S.get(found["prices"], 0)
            # The head ends where a token begins, so its letters are the line's first ones.
            kinds = S.struct(S.when(first.isNotNull(), S.left(t["kinds"], found["before"])).otherwise(t["kinds"]).alias("kinds"))
            head = S.when(first.isNotNull(), S.trim(S.left(line, first["start"]))).otherwise(line)

            def flags(h: Sql) -> Sql:
                empty = ~line.rlike("[\\p{L}0-9]")
                reach = line.rlike("^[+0-9][0-9\\s()+-]{7,}$") | S.contains(line, "@") & line.rlike("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]{2,}")
                return S.struct(
                    line.alias("text"), p.alias("prices"), h.alias("head"), S.when(first.isNotNull(), S.substring(line, first["end"] + 1, S.length(line))).otherwise("").alias("tail"),
                    _any(kinds, "size").alias("sized_head"), _any(t, "size").alias("sized"), (empty | reach | _any(t, "boilerplate")).alias("boilerplate"),
                    _any(t, "attribute").alias("attribute"), _any(t, "question").alias("question"), S.when(first.isNotNull(), _any(t, "range")).otherwise(False).alias("range"), _any(t, "inexact").alias("inexact"),
                    t["kinds"].alias("kinds"), found["behind"].alias("behind"),
                )

            return let(head, flags)

        hits = WORDS.hits(t, _RULES["price"])

        def placed(h: Sql) -> Sql:
            top = S.get(h, 0)
            return let(S.struct(_priced(line, h).alias("prices"), top["first"].alias("before"), (top["first"] + S.size(top["parts"])).alias("behind")), finish)

        return let(hits, placed)

    return let(WORDS.told(line), read)


@on_columns
def is_list(lines: Sql) -> Sql:
    """Whether two priced lines or more state a size."""
    return S.size(S.filter(lines, lambda x: (S.size(x["prices"]) > 0) & x["sized_head"] & ~x["boilerplate"])) >= 2


@on_columns
def body(lines: Sql, text: Sql) -> Sql:
    """struct<text, kinds> of a message's lines, parted by one line end each. A line end before
    all lines stays."""
    opens = text.rlike("\\A *\\n")
    joined = lambda field, by: S.array_join(S.transform(lines, lambda x: x[field]), by)
    return S.struct(S.concat(S.when(opens, "\n").otherwise(""), joined("text", "\n")).alias("text"), S.concat(S.when(opens, WORDS.other).otherwise(""), joined("kinds", WORDS.other)).alias("kinds"))


@on_columns
def scopes(rows: Sql, lines: Sql, whole: Sql) -> Sql:
    """array<struct<text, kinds>>, one for each of `decided`: the line of a list, or `body`."""
    return S.transform(rows, lambda r: S.when(r["list"], let(S.get(lines, r["line"]), lambda x: S.struct(x["text"].alias("text"), x["kinds"].alias("kinds")))).otherwise(whole))


@on_columns
def stretches(rows: Sql, lines: Sql, own: Sql, whole: Sql) -> Sql:
    """array<struct<text, kinds>> to read terms from: for each row what follows its price, then
    its scope (own: `scopes`). In a list, `body` comes last. No text is told anew."""

    def one(r: Sql, scope: Sql) -> Sql:
        def joined(x: Sql) -> Sql:
            behind = S.when(x["behind"].isNotNull(), S.substring(x["kinds"], x["behind"] + 1, S.length(x["kinds"]))).otherwise("")
            return S.struct(S.concat_ws("\n", r["tail"], scope["text"]).alias("text"), S.concat(behind, S.lit(WORDS.other), scope["kinds"]).alias("kinds"))

        return let(S.get(lines, r["line"]), joined)

    each = S.zip_with(rows, own, one)
    return S.when(S.get(rows, 0)["list"], S.concat(each, S.array(whole))).otherwise(each)


@on_columns
def with_headings(lines: Sql) -> Sql:
    """Lines in order, each with the product heading above it: the last line that states a
    size and no price. One fold carries it."""

    def step(done: Sql, x: Sql) -> Sql:
        last = S.try_element_at(done, -1)
        names = x["sized"] & (S.size(x["prices"]) == 0) & ~x["boilerplate"] & ~x["attribute"] & ~x["question"]
        above = S.when(last["names"], last["line"]["text"]).otherwise(S.coalesce(last["heading"], ""))
        return S.concat(done, S.array(S.struct(x.alias("line"), names.alias("names"), above.alias("heading"))))

    kind = (
        "array<struct<line:struct<text:string,prices:array<struct<start:int,end:int,token:string>>,head:string,tail:string,sized_head:boolean,sized:boolean,"
        "boilerplate:boolean,attribute:boolean,question:boolean,range:boolean,inexact:boolean,kinds:string,behind:int>,names:boolean,heading:string>>"
    )
    return S.aggregate(lines, S.array().cast(kind), step)


@on_columns
def product_name(lines: Sql) -> Sql:
    """The product that a message with one price is about, by falling evidence: a line with
    a size, an announcement, the first line that reads like a name; else the empty string."""

    def unlabelled(t: Sql) -> Sql:
        rest = S.trim(S.regexp_extract(t, "^[A-Za-z][A-Za-z ]{0,24}:\\s*(.+)$", 1))
        return S.when(_says(rest, "size"), rest).otherwise(S.trim(t))

    def choose(known: Sql) -> Sql:
        def first(of: Sql, read) -> Sql:
            """What the first line gives that gives something; lines behind it are not read."""
            return S.aggregate(of, S.lit(None).cast("string"), lambda done, x: S.when(done.isNotNull(), done).otherwise(read(x)))

        def of_size(x: Sql) -> Sql:
            return let(unlabelled(_bare(x["text"], x["prices"])), lambda t: S.when(_says(t, "size"), t))

        def told(x: Sql) -> Sql:
            def behind(h: Sql) -> Sql:
                rest = S.trim(S.substring(x["text"], h["end"] + 1, S.length(x["text"])))
                return S.when(S.length(rest) > 2, without_prices(rest))

            return let(S.get(WORDS.hits(x, _RULES["announced"]), 0), behind)

        sized = first(S.filter(known, lambda x: x["sized"]), of_size)
        announced = first(known, told)

        def named(x: Sql) -> Sql:
            label = S.lower(S.regexp_extract(x["text"], "^([A-Za-z][A-Za-z ]{0,24}):", 1))
            term = S.arrays_overlap(S.split(label, " +", -1), S.array(*TERM_LABELS))
            return (S.size(x["prices"]) == 0) & x["text"].rlike("[A-Za-z]{3}") & ~term

        return S.coalesce(sized, announced, S.get(S.filter(known, named), 0)["text"], "")

    return let(S.filter(lines, lambda x: ~x["boilerplate"] & ~x["attribute"] & ~x["question"]), choose)


_ROW = "array<struct<line:int,list:boolean,product:string,price:string,heading:string,tail:string,reason:string>>"


@on_columns
def decided(lines: Sql, name: Sql) -> Sql:
    """array<struct<line, list, product, price, heading, tail, reason>> of a message: its
    offers and refusals. lines: `with_headings`; name: `product_name` of them.

    With two priced lines that state a size or more the message is a list, and each line
    stands for itself; a priced line without a size is reported. Else the message's one
    price belongs to the product that it names. Ranges, approximations and several
    different prices are refused.
    """
    numbered = S.transform(lines, lambda x, k: S.struct(k.alias("k"), x["line"].alias("x"), x["heading"].alias("heading")))

    def read(every: Sql) -> Sql:
        def row(x: Sql, listed: object, product: object, price: object, reason: object) -> Sql:
            lit = lambda v: v if isinstance(v, Sql) else S.lit(v)
            fields = (x["k"], lit(listed), lit(product), lit(price), x["heading"], x["x"]["tail"], lit(reason))
            return S.struct(*(f.alias(n) for f, n in zip(fields, ("line", "list", "product", "price", "heading", "tail", "reason"))))

        def judged(p: Sql) -> Sql:
            def each(x: Sql) -> Sql:
                reason = S.when(~x["x"]["sized_head"] | x["x"]["boilerplate"], "no size").when(x["x"]["range"], "price range").when(x["x"]["inexact"], "approximate price").otherwise("")
                price = S.when(reason == "", S.get(x["x"]["prices"], 0)["token"]).otherwise("")
                return row(x, True, x["x"]["head"], price, reason)

            first, top = S.get(p, 0), S.get(every, 0)
            tokens = S.array_distinct(S.flatten(S.transform(p, lambda x: S.transform(x["x"]["prices"], lambda q: S.lower(S.regexp_replace(q["token"], "\\s+", ""))))))
            refused = lambda reason: S.array(row(S.coalesce(first, top), False, name, "", reason))
            listed = S.size(S.filter(p, lambda x: x["x"]["sized_head"] & ~x["x"]["boilerplate"])) >= 2
            return (
                S.when(listed, S.transform(S.filter(p, lambda x: x["x"]["head"] != ""), each))
                .when(S.exists(every, lambda x: x["x"]["range"]), refused("price range"))
                .when(S.size(p) == 0, S.when(S.size(every) > 0, refused("no price")).otherwise(S.array()))
                .when(S.size(tokens) > 1, refused("several prices"))
                .when(first["x"]["inexact"], refused("approximate price"))
                .when(name == "", refused("no product"))
                .otherwise(S.array(row(first, False, name, S.get(first["x"]["prices"], 0)["token"], "")))
            )

        return let(S.filter(every, lambda x: S.size(x["x"]["prices"]) > 0), judged)

    return let(numbered, read).cast(_ROW)


@on_columns
def split_quantity(product: Sql) -> Sql:
    """struct<name, qty>: dash parts at the end that are quantities or delivery terms, and a
    quantity in front, taken off the name. A count needs a unit; a name is never emptied."""

    def fold(parts: Sql) -> Sql:
        loose = lambda t: _says(t, "quantity") | _says(t, "terms")
        zero = S.struct(S.lit(0).alias("n"), S.lit(False).alias("done"))

        def step(acc: Sql, t: Sql) -> Sql:
            goes = ~acc["done"] & loose(S.trim(t))
            return S.struct((acc["n"] + S.when(goes, 1).otherwise(0)).alias("n"), (acc["done"] | ~goes).alias("done"))

        behind = S.reverse(S.slice(parts, 2, S.size(parts)))
        gone = S.aggregate(behind, zero, step, lambda acc: acc["n"])

        def cut(n: Sql) -> Sql:
            kept = S.slice(parts, 1, S.size(parts) - n)
            tail = S.transform(S.slice(parts, S.size(parts) - n + 1, n), lambda t: S.trim(t))

            def front(head: Sql) -> Sql:
                def leading(h: Sql) -> Sql:
                    rest = S.trim(S.substring(head, h["end"] + 1, S.length(head)))
                    goes = S.coalesce(h["end"] > 0, False) & (S.coalesce(rest, "") != "")
                    qty = S.concat(S.when(goes, S.array(S.left(head, h["end"]))).otherwise(S.array().cast("array<string>")), tail)
                    return S.struct(S.when(goes, rest).otherwise(head).alias("name"), S.array_join(qty, " ").alias("qty"))

                return let(S.get(_hits(head, "quantity"), 0), leading)

            return let(S.trim(S.array_join(kept, " - ")), front)

        return let(gone, cut)

    return let(S.split(product, "\\s+[–—-]\\s+", -1), fold)


def _clip(value: Sql) -> Sql:
    """A term's text up to the next sentence or term, at most 60 characters."""
    first = S.trim(S.get(S.split(value, "[.|]", -1), 0))

    def stop(v: Sql) -> Sql:
        at = S.get(_hits(v, "stop"), 0)["start"]
        return S.left(S.regexp_replace(S.when(at > 0, S.trim(S.left(v, at))).otherwise(v), "[,;/\\s]+\\z", ""), 60)

    return _unless(let(first, stop), "")


def _unless(value: Sql, none: object) -> Sql:
    """value, or null where it is none. nullif() in a lambda makes its value twice."""
    return let(value, lambda v: S.when(v != none, v))


def _stated(text: Sql, *readers) -> Sql:
    """What the first part of the text (line, or stretch between bars) states to a reader."""
    parts = S.filter(S.transform(S.split(text, "[\\n|]", -1), lambda x: S.trim(x)), lambda x: x != "")
    return S.get(S.filter(S.transform(parts, lambda p: S.coalesce(*(r(p) for r in readers))), lambda v: v.isNotNull()), 0)


def _behind(rule: str):
    def read(part: Sql) -> Sql:
        return let(S.get(_hits(part, rule), 0), lambda h: S.when(h.isNotNull(), _clip(S.substring(part, h["end"] + 1, S.length(part)))))

    return read


def _matched(rule: str):
    def read(part: Sql) -> Sql:
        return let(S.get(_hits(part, rule), 0), lambda h: S.when(h.isNotNull(), _clip(S.substring(part, h["start"] + 1, h["end"] - h["start"]))))

    return read


@on_columns
def trade_terms(told: Sql) -> Sql:
    """struct<incoterm, warehouse, bond, lead, moq>; null where nothing is stated. told: a
    struct<text, kinds>."""

    def read(t: Sql) -> Sql:
        def finish(w: Sql) -> Sql:
            text = t["text"]
            known = let(S.get(WORDS.first(t, _RULES["incoterm"]), 0)["value"], lambda code: S.when(code.isNotNull(), S.coalesce(mapped(code, INCOTERMS), S.lit("EXW"))))
            lead = _stated(text, _behind("lead_label"), _matched("lead_first"), _matched("lead_before"))
            moq = _stated(text, _behind("moq_label"), _behind("minimum_label"))
            bond = S.when(text.rlike("\\bT1\\b"), "T1").when(text.rlike("(?i)\\bT2\\b"), "T2").when(_any(t, "duty_paid"), "Duty Paid").when(_any(t, "bonded"), "Bonded")
            return S.struct(
                S.coalesce(known, S.when(w.isNotNull() & _any(t, "ex_depot"), "EXW")).alias("incoterm"),
                w.alias("warehouse"),
                bond.alias("bond"),
                S.when(text.rlike("(?i)lead|day|week|month"), lead).alias("lead"),
                S.when(text.rlike("(?i)moq|minimum"), moq).alias("moq"),
            )

        # In the order of the list, places with aliases first.
        order = sorted(range(len(WAREHOUSES)), key=lambda k: WAREHOUSES[k] not in WAREHOUSE_ALIASES)
        named = S.coalesce(*(S.when(WORDS.says(t, _PLACE + "_" * k), WAREHOUSES[k]) for k in order))
        return let(named, finish)

    return let(told, read)


@on_columns
def several_places(text: Sql) -> Sql:
    """Whether delivery terms name one place or another, in one sentence."""
    return S.coalesce(text.rlike(_SPEAKS["several"]), S.lit(False)) & S.exists(S.split(S.coalesce(text, ""), "[.\\n]", -1), lambda s: _says(s, "several"))


@on_columns
def attributes(qty: Sql, scope: Sql) -> Sql:
    """struct<stock_cases, cases_per_pallet, pcs_case, bbd, ean> of a quantity and the text
    (struct<text, kinds>) behind it, each null unless stated. A best-before range is no date."""

    def read(t: Sql) -> Sql:
        text = t["text"]

        def number(rule: str) -> Sql:
            digits = S.array_join(S.transform(S.filter(WORDS.first(t, _RULES[rule]), lambda p: S.contains(WORDS.classes["number"], p["kind"])), lambda p: S.regexp_replace(p["value"], "[.,]", "")), "")
            return _unless(digits.try_cast("bigint"), 0)

        date = "(?i)\\bbbd\\b\\s*[:-]?\\s*([0-9]{1,4}(?:[./-][0-9]{1,4}){1,2})"
        ranged = S.regexp_extract(text, date + "(\\s*(?:[-–]|to)\\s*[0-9])?", 2) != ""
        ean = WORDS.pick(WORDS.first(t, _RULES["ean"]), "number")
        return S.struct(
            number("stock").alias("stock_cases"),
            number("per_pallet").alias("cases_per_pallet"),
            S.coalesce(number("per_case"), number("packing")).alias("pcs_case"),
            S.when(text.rlike("(?i)bbd"), S.when(~ranged, _unless(S.regexp_extract(text, date, 1), ""))).alias("bbd"),
            let(ean, lambda v: S.when(v.rlike("^(?:[0-9]{8}|[0-9]{12,14})$"), v)).alias("ean"),
        )

    return let(S.struct(S.concat_ws(" ", qty, scope["text"]).alias("text"), S.concat(WORDS.letters(qty), scope["kinds"]).alias("kinds")), read)
