"""What a text says of its parties, where an extraction left it out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .records import filled, path, updated
from .text import let
from .values import inn_valid, normalize_inn

# Labels of parties, what stands before a bank's own numbers, and countries that are home.
LABELS = (("поставщик", "seller"), ("продавец", "seller"), ("покупатель", "buyer"), ("заказчик", "buyer"), ("грузоотправитель", "shipper"), ("грузополучатель", "consignee"), ("перевозчик", "carrier"), ("плательщик", "payer"))
BANK = r"(?=[бкср])(?:банк|бик(?=[A-Za-z0-9_])|к/с|кор(?:р|\.)\s*сч|корсчет|корреспондент|сч\.\s*№|р/с)"
HOME = ("RU", "РФ", "RUS", "РОССИЯ", "RUSSIA")
PARTIES = tuple(dict.fromkeys(party for _, party in LABELS))
NEAR = r"инн(?:\s*/?\s*кпп)?[\s:№#/]*([0-9]{12}|[0-9]{10})(?![0-9])"
# A look at the first letter spares most places the words.
_LABEL = "(?iuU)(?=[" + "".join(sorted({word[0] for word, _ in LABELS})) + "])(" + "|".join(word for word, _ in LABELS) + r")\s*:?"


def party_windows(text: Column, reach: int = 400) -> Column:
    """(party, window) for each label of a party in a text, in order: what follows it up to the next label, to ``reach``
    characters or to a mark of a bank block, whichever comes first."""
    words = F.regexp_extract_all(text, F.lit(_LABEL), F.lit(1))
    after = F.slice(F.split(text, _LABEL, -1), 2, F.size(words))
    party = F.create_map(*[F.lit(x) for pair in LABELS for x in pair])
    cut = lambda w: F.get(F.split(F.left(w, F.lit(reach)), "(?iuU)" + BANK, 2), F.lit(0))
    return F.zip_with(words, after, lambda word, w: F.struct(F.try_element_at(party, F.lower(word)).alias("party"), cut(w).alias("window")))


def recovered_inns(record: Column, text: Column) -> Column:
    """Taxpayer numbers by path that a text gives behind a party's label, for parties that have no valid one and aren't
    foreign; the first window of a party whose first number passes its check digits counts. An empty map for none."""
    near = F.transform(party_windows(text), lambda w: F.struct(w["party"], F.nullif(F.regexp_extract(w["window"], "(?iuU)" + NEAR, 1), F.lit("")).alias("inn")))
    valid = F.filter(near, lambda w: inn_valid(w["inn"]))

    def pick(x: Column) -> Column:
        found, own, pairs = x["found"], x["record"], []
        for p in PARTIES:
            country = F.upper(F.regexp_replace(path(own, f"{p}.country"), r"(?U)^\s+|\s+$", ""))
            foreign = filled(country) & ~F.coalesce(country, F.lit("")).isin(*HOME)
            inn = F.get(F.filter(found, lambda w: w["party"] == F.lit(p)), F.lit(0))["inn"]
            pairs.append(F.when(inn.isNotNull() & normalize_inn(path(own, f"{p}.inn")).isNull() & ~foreign, F.struct(F.lit(f"{p}.inn").alias("key"), inn.alias("value"))))
        return F.map_from_entries(F.array_compact(F.array(*pairs)))

    none = F.expr("CAST(map() AS map<string,string>)")
    return F.coalesce(let(F.struct(valid.alias("found"), record.alias("record")), pick), none)


def recover_inns(record: Column, text: Column) -> Column:
    """The record with the numbers that ``recovered_inns`` finds."""
    return let(recovered_inns(record, text), lambda found: updated(record, F.map_entries(found)))
