"""Parties, addresses and people: activity, resolution, suggestions, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.text import FREEMAIL, domain_of, domain_title, name_key

OPEN = "￿"


def activity(messages: DataFrame, recipients: DataFrame) -> DataFrame:
    """``(address, name, message_id, sent_at)``: each message seen by each address on it."""
    m = messages.dropDuplicates(["message_id"])
    sent = m.select(F.lower("from_address").alias("address"), F.col("from_name").alias("name"), "message_id", "sent_at")
    got = recipients.select("message_id", F.lower("address").alias("address"), "name", "kind").distinct().join(m.select("message_id", "sent_at"), "message_id").select("address", "name", "message_id", "sent_at")
    return sent.unionByName(got).filter(F.col("address").rlike(r"^.+@[^@]+$"))


def address_stats(acts: DataFrame) -> DataFrame:
    """``(address, domain, messages, min_at, max_at, person)``; person is the most used name.

    Ties go to the smallest name; blank names do not count. Distinct messages and names are
    counted on partial aggregates, never by gathering an address's rows.
    """
    per = acts.groupBy("address", "message_id").agg(F.min("sent_at").alias("lo"), F.max("sent_at").alias("hi"))
    stat = per.groupBy("address").agg(F.count("*").alias("messages"), F.min("lo").alias("min_at"), F.max("hi").alias("max_at"))
    named = acts.filter(F.trim("name") != "").groupBy("address", "name").agg(F.count("*").alias("n"))
    person = named.groupBy("address").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("name").alias("p"))).alias("best")).select("address", F.col("best.p").alias("person"))
    return stat.join(person, "address", "left").select("address", domain_of("address").alias("domain"), "messages", "min_at", "max_at", "person")


def resolve(questions: DataFrame, mappings: DataFrame) -> DataFrame:
    """Party of an address on a day: latest start wins, open starts earliest, ties by party.

    ``questions`` is (address, day), a NULL day meaning open mappings count whenever; mappings are
    (address, party_id, person, from_date, to_date), NULL ends being open.
    """
    q = questions.withColumn("_q", F.lower("address")).withColumn("_id", F.xxhash64("address", "day"))
    m = mappings.select(F.lower("address").alias("_q"), "party_id", "person", "from_date", "to_date")
    fits = (F.col("day").isNull() | F.col("from_date").isNull() | (F.col("from_date") <= F.col("day"))) & (F.col("day").isNull() | F.col("to_date").isNull() | (F.col("day") < F.col("to_date")))
    hit = q.join(m, "_q").filter(fits)
    best = Window.partitionBy("address", "day").orderBy(F.desc_nulls_last("from_date"), "party_id")
    return hit.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("address", "day", "party_id", "person")


def timeline(facts: DataFrame, documents: DataFrame | None, messages: DataFrame, recipients: DataFrame, mappings: DataFrame) -> DataFrame:
    """``(party_id, at, type, ref, summary)`` of all parties at once.

    Facts believed now, dated documents, and messages from or to an address of the party
    (whatever its window). ``mappings`` is (address, party_id).
    """
    f = facts.filter("expired_at is null").select(F.col("entity").alias("party_id"), F.col("valid_from").alias("at"), F.lit("fact").alias("type"), F.col("fact_id").cast("string").alias("ref"), F.concat_ws(" = ", "relation", "value_json").alias("summary")).distinct()
    own = mappings.select(F.lower("address").alias("address"), "party_id").distinct()
    m = messages.dropDuplicates(["message_id"]).filter("sent_at is not null")
    touched = m.select("message_id", F.lower("from_address").alias("address")).unionByName(recipients.select("message_id", F.lower("address").alias("address"))).distinct()
    of_party = touched.join(own, "address").select("message_id", "party_id").distinct()
    g = of_party.join(m.select("message_id", "sent_at", "subject"), "message_id").select("party_id", F.col("sent_at").alias("at"), F.lit("message").alias("type"), F.col("message_id").alias("ref"), F.col("subject").alias("summary"))
    out = f.unionByName(g)
    if documents is not None:
        out = out.unionByName(documents.filter("issued_date is not null and party_id is not null").select("party_id", F.col("issued_date").alias("at"), F.lit("document").alias("type"), F.col("doc_id").cast("string").alias("ref"), F.concat_ws(" ", "kind", F.col("doc_id").cast("string")).alias("summary")))
    return out


def _party_json(present: Column, party: Column, name: Column) -> Column:
    return F.when(present, F.struct(party.alias("partyId"), name.alias("name"), F.lit("company").alias("kind")))


def suggestion_id(kind: Column, new_party: Column, mappings: Column) -> Column:
    """First 16 hex digits of the hash of the proposal's compact JSON, absent keys left out."""
    return F.substring(F.sha2(F.to_json(F.struct(kind.alias("kind"), new_party.alias("newParty"), mappings.alias("mappings"))), 256), 1, 16)


def _mapping(address: Column, party: Column, person: Column, from_date: Column | None = None, to_date: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(address.alias("address"), party.alias("partyId"), person.alias("person"), (none if from_date is None else from_date).alias("fromDate"), (none if to_date is None else to_date).alias("toDate"))


def suggest(messages: DataFrame, recipients: DataFrame, parties: DataFrame, mappings: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Proposed links, never applied: ``(suggestion_id, kind, new_party, mappings, status)``.

    domain_party: unmapped addresses of one firm domain (two or more, or five messages);
    same_person: one name on several addresses of one party, some unmapped; person_move: one name
    whose addresses, in order of first activity, belong to different parties, the earlier being
    mapped. ``parties`` is (party_id, name, kind), ``mappings`` (address, party_id, ...),
    ``decisions`` (suggestion_id, status).
    """
    acts = activity(messages, recipients)
    stats = address_stats(acts)
    own = mappings.select(F.lower("address").alias("address"), "party_id").distinct()
    mapped = own.groupBy("address").agg(F.min("party_id").alias("party"), F.count("*").alias("n_parties"))
    owners = own.select(domain_of("address").alias("domain"), "party_id").filter("domain <> ''").distinct().groupBy("domain").agg(F.min("party_id").alias("owner"), F.count("*").alias("n_owners")).filter("n_owners = 1").select("domain", "owner")
    known = parties.select("party_id", F.col("name").alias("p_name"), F.col("kind").alias("p_kind")).dropDuplicates(["party_id"])
    dom = stats.select("domain").filter("domain <> ''").distinct()
    dom = dom.join(owners, "domain", "left").withColumn("proposed", F.concat(F.lit("party:"), F.col("domain"))).withColumn("title", domain_title("domain"))
    dom = dom.join(known.withColumnRenamed("party_id", "proposed"), "proposed", "left")
    dom = dom.withColumn("existing", F.coalesce("owner", F.when(F.col("p_name").isNotNull(), F.col("proposed")))).withColumn("fresh", F.col("p_name").isNull() | ((F.col("p_name") == F.col("title")) & (F.col("p_kind") == "company"))).select("domain", "proposed", "title", "existing", "fresh")
    free = F.col("domain").isin(FREEMAIL) | (F.col("domain") == "")
    a = stats.join(mapped, "address", "left").join(dom, "domain", "left")

    joining = a.filter(~free & (F.col("party").isNull() | ((F.col("n_parties") == 1) & (F.col("party") == F.col("proposed")))))
    seen = acts.select("address", "message_id").distinct().join(joining.select("address", "domain"), "address").select("domain", "message_id").distinct().groupBy("domain").agg(F.count("*").alias("n_messages"))
    kind1 = (
        joining.groupBy("domain", "proposed", "title", "fresh")
        .agg(F.array_sort(F.collect_list(_mapping(F.col("address"), F.col("proposed"), F.col("person")))).alias("maps"), F.count("*").alias("n"))
        .join(seen, "domain")
        .filter("n >= 2 or n_messages >= 5")
        .select(F.lit("domain_party").alias("kind"), _party_json(F.col("fresh"), F.col("proposed"), F.col("title")).alias("new_party"), "maps")
    )

    named = acts.filter(F.trim("name") != "").select("address", "name", name_key("name").alias("norm")).filter("length(norm) >= 6 and norm like '% %'")
    spell = named.groupBy("norm", "name").agg(F.count("*").alias("n")).groupBy("norm").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("name").alias("p"))).alias("b")).select("norm", F.col("b.p").alias("who"))
    uses = named.select("norm", "address").distinct().join(a, "address")
    uses = uses.withColumn("context", F.coalesce("party", F.when(~free, F.coalesce("existing", "proposed"))))
    groups = uses.groupBy("norm").agg(F.count("*").alias("n_addr"), F.count_distinct("context").alias("n_ctx"), F.min("context").alias("ctx"), F.count("party").alias("n_mapped")).filter("n_addr >= 2").join(spell, "norm")
    kind2 = (
        uses.filter("party is null")
        .join(groups.filter("n_ctx = 1 and n_mapped > 0"), "norm")
        .groupBy("norm", "ctx", "who")
        .agg(F.array_sort(F.collect_list(_mapping(F.col("address"), F.col("ctx"), F.col("who")))).alias("maps"))
        .select(F.lit("same_person").alias("kind"), F.lit(None).cast("struct<partyId:string,name:string,kind:string>").alias("new_party"), "maps")
    )
    w = Window.partitionBy("norm").orderBy(F.coalesce("min_at", F.lit(OPEN)), "address")
    me = F.struct("address", "context", "party", "min_at", "max_at", "domain", "existing", "proposed", "title", "fresh")
    steps = uses.join(groups.filter("n_ctx >= 2").select("norm", "who"), "norm").withColumn("me", me).withColumn("was", F.lag("me").over(w)).filter("was is not null")
    steps = steps.filter(F.col("was.context").isNotNull() & F.col("context").isNotNull() & (F.col("was.context") != F.col("context")) & F.col("was.party").isNotNull() & (F.col("party").isNotNull() | ~free))
    later = F.when(F.col("party").isNotNull(), F.col("context")).otherwise(F.coalesce("existing", "proposed"))
    fresh = F.col("party").isNull() & F.col("existing").isNull() & F.col("fresh")
    edge = F.when(F.col("was.max_at").isNotNull() & F.col("min_at").isNotNull() & (F.col("was.max_at") <= F.col("min_at")), F.substring("min_at", 1, 10))
    both = F.array_sort(F.array(_mapping(F.col("address"), later, F.col("who"), from_date=edge), _mapping(F.col("was.address"), F.col("was.context"), F.col("who"), to_date=edge)))
    kind3 = steps.select(F.lit("person_move").alias("kind"), _party_json(fresh, F.col("proposed"), F.col("title")).alias("new_party"), both.alias("maps"))

    out = kind1.unionByName(kind2).unionByName(kind3).withColumn("suggestion_id", suggestion_id(F.col("kind"), F.col("new_party"), F.col("maps"))).dropDuplicates(["suggestion_id"])
    if decisions is not None:
        out = out.join(decisions.select("suggestion_id", F.col("status").alias("_s")), "suggestion_id", "left").withColumn("status", F.coalesce("_s", F.lit("suggested")))
    else:
        out = out.withColumn("status", F.lit("suggested"))
    return out.select("suggestion_id", "kind", "new_party", F.col("maps").alias("mappings"), "status")
