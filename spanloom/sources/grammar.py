"""A seeded grammar of service conversations: weighted templates with slots, expanded by hash, spans from running offsets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import prob, text

#: Templates: a kind's weight, and its lines for typed and for spoken dialogues. {slot} is filled in, {slot:LABEL} is a span
#: as well. Decoys have no spans, though they hold digits and names of things.
TEMPLATES: dict[str, tuple[int, str, str]] = {
    "card": (4,
             "Caller: {greet}this is {name:PERSON}.\nDesk: Good day {first:PERSON}, what happened?\nCaller: A shop took money twice from the card ending in {last4:ACCOUNT_NUMBER}.\nDesk: Which card is that in full?\nCaller: {card:ACCOUNT_NUMBER}\nDesk: And the three digits on its back?\nCaller: {code:SECRET}\n",
             "Caller: {greet}this is {name:PERSON}.\nDesk: Good day {first:PERSON}, what happened?\nCaller: A shop took money twice from the card ending in {last4_said:ACCOUNT_NUMBER}.\nDesk: Which card is that in full?\nCaller: {card_a_said:ACCOUNT_NUMBER}\nDesk: yes\nCaller: {card_b_said:ACCOUNT_NUMBER}\nDesk: And the three digits on its back?\nCaller: {code_said:SECRET}\n"),
    "account": (3,
                "Caller: {greet}{name:PERSON} here, about account {account:ACCOUNT_NUMBER}. My number is {phone:PHONE}.\nDesk: Thank you {first:PERSON}. Shall the statement go to {email:EMAIL}?\n",
                "Caller: {greet}{name:PERSON} here, about account {account_said:ACCOUNT_NUMBER}. My number is {phone_said:PHONE}.\nDesk: Thank you {first:PERSON}. Shall the statement go to {email:EMAIL}?\n"),
    "address": (2, "Caller: {greet}I am {name:PERSON} and live at {street:ADDRESS} now.\nDesk: Changed. You find your page at {url:URL}\n", "Caller: {greet}I am {name:PERSON} and live at {street:ADDRESS} now.\nDesk: Changed, thanks {first:PERSON}.\n"),
    "login": (2, "Caller: {greet}user {user:OTHER_PII} can't sign in with {secret:SECRET}.\nDesk: The last try came from {ip:OTHER_PII}.\n", "Caller: {greet}user {user:OTHER_PII} can't sign in.\nDesk: Say the code that we sent.\nCaller: {code_said:SECRET}\n"),
    "birth": (2, "Desk: When were you born?\nCaller: {born:DATE}\nDesk: Thank you, {first:PERSON}.\n", "Desk: When were you born?\nCaller: {born:DATE} uh yes\nDesk: Thank you, {first:PERSON}.\n"),
    "decoy": (2, "Caller: {greet}do you open before {hour} on Saturdays?\nDesk: From {hour} on, at all {n} branches.\n", "Caller: {greet}uh how do I reach menu {n}?\nDesk: Press {n}, then wait.\n"),
}
#: Share of spoken dialogues.
SPOKEN = 0.35
FIRST, LAST = ("Ada", "Emil", "Ines", "Jonas", "Lotte", "Mara", "Noor", "Piet"), ("Abel", "Brandt", "Costa", "Dumas", "Ekholm", "Ferrari", "Novak", "Weiss")
GREETINGS = ("Hello, ", "Good morning, ", "")
STREETS = ("Mill Road", "Harbour Lane", "Station Street")


@dataclass(frozen=True)
class Draws:
    """Numbers below n drawn for a seed row: the same in the plan and in SQL."""

    salt: str
    key: str

    def number(self, what: str, n: int) -> Column:
        return F.least(F.lit(n - 1), F.floor(prob.unit(f"{self.salt}:{what}", F.col(self.key)) * n)).cast("long")

    def digits(self, what: str, k: int) -> Column:
        """k digits, four a draw."""
        parts = [F.lpad(self.number(f"{what}{i}", 10_000).cast("string"), 4, "0") for i in range(-(-k // 4))]
        return F.substring(F.concat(*parts), 1, k)

    def one(self, what: str, of: tuple[str, ...]) -> Column:
        return F.get(F.array(*[F.lit(x) for x in of]), self.number(what, len(of)).cast("int"))


def with_check_digit(digits: Column) -> Column:
    """The number that ends in the digit which makes its Luhn sum a multiple of ten."""
    return F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(digits, c.cast("string"))), text.luhn_ok), F.lit(0))


def slots(d: Draws) -> dict[str, Column]:
    """What fills each slot. Spoken numbers are spelled, with a filler before every fourth digit; a card is said in two parts."""
    card, said = with_check_digit(F.concat(F.lit("4"), d.digits("card", 14))), lambda c: text.spell(c, "uh")
    first, last, code, account = d.one("first", FIRST), d.one("last", LAST), d.digits("code", 3), d.digits("account", 10)
    phone = d.digits("phone", 4)
    user = F.concat(F.lower(first), d.number("user", 900).cast("string"))
    born = F.concat_ws("-", (d.number("year", 66) + 1940).cast("string"), F.lpad((d.number("month", 12) + 1).cast("string"), 2, "0"), F.lpad((d.number("day", 28) + 1).cast("string"), 2, "0"))
    return {
        "greet": d.one("greet", GREETINGS), "first": first, "name": F.concat_ws(" ", first, last), "card": card, "last4": F.substring(card, 13, 4), "last4_said": said(F.substring(card, 13, 4)),
        "card_a_said": said(F.substring(card, 1, 8)), "card_b_said": said(F.substring(card, 9, 8)), "code": code, "code_said": said(code), "account": account, "account_said": said(account),
        "phone": F.concat(F.lit("+1 202 555 "), phone), "phone_said": said(F.concat(F.lit("202555"), phone)), "email": F.concat(user, F.lit("@example.com")), "url": F.concat(F.lit("https://example.org/"), user), "user": user,
        "street": F.concat_ws(" ", (d.number("house", 300) + 1).cast("string"), d.one("street", STREETS)), "secret": F.concat(F.lit("pw-"), d.digits("secret", 8)),
        "ip": F.concat_ws(".", *[d.number(f"ip{i}", 256).cast("string") for i in range(4)]), "born": born, "hour": (d.number("hour", 9) + 1).cast("string"), "n": (d.number("n", 8) + 2).cast("string"),
    }


def parts(template: str) -> list[tuple[str, str | None, bool]]:
    """(text or slot, label, is slot) in order."""
    out = []
    for plain, slot, label in re.findall(r"([^{]+)|\{(\w+)(?::(\w+))?\}", template):
        out.append((slot or plain, label or None, bool(slot)))
    return out


def kind_of(u: Column, templates: dict[str, tuple[int, str, str]]) -> Column:
    """A kind by weight from a draw in [0, 1]."""
    total, upto, case = sum(w for w, *_ in templates.values()), 0, None
    for k, (w, *_) in templates.items():
        upto += w
        case = F.when(u < upto / total, k) if case is None else case.when(u < upto / total, k)
    return F.coalesce(case, F.lit(list(templates)[-1]))


def expand(seeds: DataFrame, key: str, salt: str, templates: dict[str, tuple[int, str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, text, cluster_id, spans): a dialogue for each row of seeds, drawn from its key. Cluster: kind and channel.

    A row's template becomes an array of its parts; spans get their offsets from the lengths of the parts before them, so
    each span equals its slice. Rows of one key are alike. Nothing is shuffled.
    """
    fills = slots(Draws(salt, key))
    d = seeds.select(F.col(key)).withColumn("_kind", kind_of(prob.unit(f"{salt}:kind", F.col(key)), templates)).withColumn("_spoken", prob.unit(f"{salt}:channel", F.col(key)) < SPOKEN)
    case = None
    for k, (_, typed, spoken) in templates.items():
        for is_spoken, template in ((False, typed), (True, spoken)):
            row = F.array(*[F.struct((fills[x] if slot else F.lit(x)).alias("text"), F.lit(label).cast("string").alias("label")) for x, label, slot in parts(template)])
            this = (F.col("_kind") == k) & (F.col("_spoken") == is_spoken)
            case = F.when(this, row) if case is None else case.when(this, row)
    none = F.array().cast("array<struct<start:int,end:int,label:string,surface:string,source:string>>")

    def step(acc: Column, p: Column) -> Column:
        to = acc["at"] + F.length(p["text"])
        span = F.struct(acc["at"].alias("start"), to.alias("end"), p["label"].alias("label"), p["text"].alias("surface"), F.lit("synthetic").alias("source"))
        return F.struct(to.alias("at"), F.when(p["label"].isNotNull(), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    d = d.withColumn("_parts", case)
    spans = F.aggregate("_parts", F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda a: a["spans"])
    channel = F.when(F.col("_spoken"), "spoken").otherwise("typed")
    return d.select(F.concat(F.lit("synth_"), F.col(key).cast("string")).alias("doc_id"), F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text"), F.concat_ws(":", "_kind", channel).alias("cluster_id"), spans.alias("spans"))
