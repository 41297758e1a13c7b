"""Language of a text by indicator words (LD6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Indicator words by language, in order of precedence.
WORDS = {
    "en": "the is are was were have has be been being and or but if then this that these those".split(),
    "es": "el la los las un una de en que es por para con su al se le lo".split(),
    "fr": "le la les un une des de du en que qui est pas sur pour avec plus ce mais".split(),
    "de": "der die das und in zu den nicht mit sie es von auch auf ein eine".split(),
    "pt": "o a os as um uma de em que e para com nao por mais como".split(),
    "it": "il la di che e in un una per non sono con da io lei".split(),
    "zh": "的 是 在 有 和 了 我 你 他 她 它 们 这 那 来 去".split(),
    "ja": "の は が を に と で も な か から まで より".split(),
}


def by_words(c: Column) -> Column:
    """LD6: the language with the most distinct indicator words; English if none has any; the first of equals."""
    own = F.split(F.lower(c), "\\s+")
    scores = [F.struct(F.size(F.array_intersect(own, F.array(*map(F.lit, ws)))).alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("l")) for i, (k, ws) in enumerate(WORDS.items())]
    return F.when(c == "", "unknown").otherwise(F.array_max(F.array(*scores))["l"])
