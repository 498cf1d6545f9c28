"""Account and partner tags from a rule config, as native columns: no join and no shuffle."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailtables.functions.patterns import to_java
from mailtables.operators import rule_table
from mailtables.schema import TAG

# Points per kind of hit and the score a primary account needs.
ALIAS_WEIGHT = 1
KEYWORD_WEIGHT = 1
DOMAIN_WEIGHT = 2
THRESHOLD = 2


@dataclass(frozen=True)
class Account:
    name: str
    aliases: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    partners: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()


#: Address overrides written into the plan as literals; a longer list is joined.
LITERAL_ADDRESSES = 100
#: Rule words written into the plan as `contains` expressions; with more, all words go through automata.
LITERAL_WORDS = 64


@dataclass(frozen=True)
class Rules:
    """Account rules in config order, and the overrides that win over them.

    Accounts are either listed or, when they are too many for one machine, rows of `table` (see `table_rules`).
    """

    accounts: tuple[Account, ...] = ()
    addresses: dict[str, str] = field(default_factory=dict)
    subjects: tuple[tuple[str, str], ...] = ()
    keyword_weight: int = KEYWORD_WEIGHT
    domain_weight: int = DOMAIN_WEIGHT
    alias_weight: int = ALIAS_WEIGHT
    threshold: int = THRESHOLD
    table: DataFrame | None = None


def rules_from_config(config: dict) -> Rules:
    """Rules of a loaded config. Subject patterns are compiled here, so a bad one fails before the job runs."""
    overrides = config.get("overrides") or {}
    weights = config.get("tagging") or {}
    subjects = tuple(
        (item["pattern"], item["account"])
        for item in overrides.get("subject_patterns") or []
        if item.get("pattern") and item.get("account")
    )
    for pattern, _ in subjects:
        re.compile(pattern)
    return Rules(
        accounts=tuple(
            Account(
                item["name"],
                *(tuple(str(word) for word in item.get(key) or ())
                  for key in ("aliases", "domains", "partners", "keywords")),
            )
            for item in config.get("accounts") or []
        ),
        addresses=dict(overrides.get("addresses") or {}),
        subjects=subjects,
        keyword_weight=weights.get("keyword_weight", KEYWORD_WEIGHT),
        domain_weight=weights.get("domains_weight", DOMAIN_WEIGHT),
    )


def table_rules(rows: DataFrame, **weights) -> Rules:
    """Rules whose accounts are the rows of a table (see `rules_from_table`), of any size: they stay with Spark, and
    tasks read them in runs of bounded size. Accounts of one place go by name."""
    columns = ("place", "name", "aliases", "domains", "partners", "keywords")
    return Rules(table=rows.select(*columns), **weights)


#: `rules_from_table` reads a rule table into the driver, as listed accounts, only within these bounds.
TABLE_ROWS = 2_000_000
TABLE_BYTES = 256 << 20


def rules_from_table(rows: DataFrame, **weights) -> Rules:
    """Rules whose accounts are the rows of a table: place (config order), name, aliases, domains, partners, keywords
    (arrays of strings). The table is counted before it is read, and must lie within TABLE_ROWS and TABLE_BYTES."""
    lists = ("aliases", "domains", "partners", "keywords")
    width = F.octet_length("name") + sum(F.coalesce(F.octet_length(F.array_join(c, "")), F.lit(0)) + 16 for c in lists)
    count, wide = rows.agg(F.count("*"), F.sum(width)).first()
    if count > TABLE_ROWS or (wide or 0) > TABLE_BYTES:
        raise ValueError(f"a rule table of {count} rows and {wide} bytes is beyond the bounds of one driver")
    accounts = tuple(
        Account(r["name"], *(tuple(w for w in (r[c] or ()) if w) for c in lists))
        for r in rows.orderBy("place").collect()
    )
    return Rules(accounts=accounts, **weights)


def load_config(path: str) -> dict:
    """A YAML config file, read once on the driver."""
    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file) or {}


def rule_words(rules: Rules) -> int:
    """The number of words and domains that the accounts' rules look for."""
    return sum(len(a.aliases) + len(a.keywords) + len(a.domains) + len(a.partners) for a in rules.accounts)


def tag_accounts(messages: DataFrame, rules: Rules, match: str = "substring", method: str = "auto") -> DataFrame:
    """Add `account_tag`, `partner_tags` and `tags` (`array<struct<tag,kind>>`).

    Needs `sender_email`, `recipients_to/cc/bcc`, `subject` and `body`. An address override wins, then the
    first subject pattern that matches; both leave out partners. Otherwise the first account whose score
    reaches the threshold is primary, and the partners of every account, primary or not, are tagged when the
    text names them. `match="word"` asks for whole words where the default takes any substring.

    Rules whose accounts are a table's rows always take the method `table`.

    `method`: `expressions` writes one `contains` per rule word into the plan; `table` scans each text once with
    automata over all words (`rule_table`), so the plan does not grow with the rules; `auto` takes the table beyond
    `LITERAL_WORDS` words. Both give the same rows.
    """
    if rules.table is not None and method == "expressions":
        raise ValueError("the accounts of a table are not written into the plan as expressions")
    blank = F.lit("")
    recipients = [F.concat_ws("\n", c) for c in ("recipients_to", "recipients_cc", "recipients_bcc")]
    staged = messages.withColumn(
        "_text", F.lower(F.concat(F.coalesce("subject", blank), F.lit("\n"), F.coalesce("body", blank)))
    ).withColumn("_addresses", F.lower(F.concat_ws("\n", F.col("sender_email"), *recipients)))
    if len(rules.addresses) > LITERAL_ADDRESSES:
        staged = _listed(staged, rules.addresses)
    if rules.table is not None or method == "table" or (method == "auto" and rule_words(rules) > LITERAL_WORDS):
        staged, primary, named = rule_table.tag_by_table(staged, rules, match)
        found = staged.withColumn("_override", _override(rules)).withColumn("_primary", primary).withColumn(
            "_partners", named
        ).drop(*rule_table.pass_columns(staged))
    else:
        found = staged.withColumn("_override", _override(rules)).withColumn(
            "_primary", _primary(rules, match)
        ).withColumn("_partners", _partners(rules, match))
    account = F.coalesce("_override", "_primary")
    partners = F.when(F.col("_override").isNull(), F.col("_partners")).otherwise(F.array().cast("array<string>"))
    tagged = found.withColumn("account_tag", account).withColumn("partner_tags", partners)
    own = F.when(F.col("account_tag").isNotNull(), F.array(_tag(F.col("account_tag"), "account"))).otherwise(
        F.array().cast(f"array<{TAG}>")
    )
    tags = F.concat(own, F.transform("partner_tags", lambda partner: _tag(partner, "partner")))
    return tagged.withColumn("tags", tags).drop("_text", "_addresses", "_override", "_primary", "_partners", "_listed")


def _listed(messages: DataFrame, addresses: dict[str, str]) -> DataFrame:
    """Add `_listed`: the account of a listed sender, by a join. The list is broadcast only while it is short."""
    rows = messages.sparkSession.createDataFrame(list(addresses.items()), "_listed_sender string, _listed string")
    if sum(len(key) + len(value) for key, value in addresses.items()) + 32 * len(addresses) <= 32 << 20:
        rows = F.broadcast(rows)
    sender = F.coalesce(messages["sender_email"], F.lit(""))
    return messages.join(rows, sender == rows["_listed_sender"], "left").drop("_listed_sender")


def tag_rows(messages: DataFrame) -> DataFrame:
    """One row per tag of messages with a `tags` column."""
    return messages.select("message_id", F.inline_outer("tags")).where(F.col("tag").isNotNull())


def _tag(tag: Column, kind: str) -> Column:
    return F.struct(tag.alias("tag"), F.lit(kind).alias("kind"))


def _override(rules: Rules) -> Column:
    nothing = F.lit(None).cast("string")
    choices = [nothing]
    if len(rules.addresses) > LITERAL_ADDRESSES:
        choices.append(F.col("_listed"))
    elif rules.addresses:
        pairs = [F.lit(value) for pair in rules.addresses.items() for value in pair]
        choices.append(F.try_element_at(F.create_map(*pairs), F.coalesce("sender_email", F.lit(""))))
    subject = F.coalesce("subject", F.lit(""))
    choices += [F.when(subject.rlike(to_java(pattern)), F.lit(account)) for pattern, account in rules.subjects]
    return F.coalesce(*choices)


def _occurs(word: str, match: str) -> Column:
    word = word.lower()
    if match == "word":
        return F.col("_text").rlike(to_java(r"\b" + re.escape(word) + r"\b"))
    return F.contains("_text", F.lit(word))


def _any(conditions: list[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def _primary(rules: Rules, match: str) -> Column:
    choices = [F.lit(None).cast("string")]
    for account in rules.accounts:
        # An address list joined by line breaks contains '@domain' where one of its addresses does.
        domain = _any([F.contains("_addresses", F.lit("@" + d.lower())) for d in account.domains])
        alias = _any([_occurs(word, match) for word in account.aliases])
        keyword = _any([_occurs(word, match) for word in account.keywords])
        score = (
            F.when(domain, rules.domain_weight).otherwise(0)
            + F.when(alias, rules.alias_weight).otherwise(0)
            + F.when(keyword, rules.keyword_weight).otherwise(0)
        )
        choices.append(F.when(score >= rules.threshold, F.lit(account.name)))
    return F.coalesce(*choices)


def _partners(rules: Rules, match: str) -> Column:
    """Named partners, each once, in the order the config first mentions them."""
    names = list(dict.fromkeys(partner for account in rules.accounts for partner in account.partners))
    if not names:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(_occurs(name, match), F.lit(name)) for name in names]))
