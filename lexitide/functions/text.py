"""Cleaning, tokens, n-grams and inverted indexes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = tuple(
    """a about above across after afterwards again against all almost alone along already also although always am among amongst amoungst
amount an and another any anyhow anyone anything anyway anywhere are around as at back be became because become becomes becoming been
before beforehand behind being below beside besides between beyond bill both bottom but by call can cannot cant co con could couldnt cry
de describe detail do done down due during each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything
everywhere except few fifteen fifty fill find fire first five for former formerly forty found four from front full further get give go had
has hasnt have he hence her here hereafter hereby herein hereupon hers herself him himself his how however hundred i ie if in inc indeed
interest into is it its itself keep last latter latterly least less ltd made many may me meanwhile might mill mine more moreover most
mostly move much must my myself name namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of off
often on once one only onto or other others otherwise our ours ourselves out over own part per perhaps please put rather re same see seem
seemed seeming seems serious several she should show side since sincere six sixty so some somehow someone something sometime sometimes
somewhere still such system take ten than that the their them themselves then thence there thereafter thereby therefore therein thereupon
these they thick thin third this those though three through throughout thru thus to together too top toward towards twelve twenty two un
under until up upon us very via was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon
wherever whether which while whither who whoever whole whom whose why will with within without would yet you your yours yourself
yourselves""".split()
)

#: Words that the tokenizer splits in two.
CONTRACTIONS = {"cannot": "can not", "gimme": "gim me", "gonna": "gon na", "gotta": "got ta", "lemme": "lem me", "wanna": "wan na"}


def clean_text(text: Column) -> Column:
    """Lower-case letters a-z and single spaces only; null gives the empty string."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+", " "))


def words(clean: Column) -> Column:
    """Words of cleaned text; the empty string has none."""
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def word_count(clean: Column) -> Column:
    return F.when(clean == "", F.lit(0)).otherwise(F.size(F.split(clean, " ")))


def split_contractions(clean: Column) -> Column:
    for whole, parts in CONTRACTIONS.items():
        clean = F.regexp_replace(clean, rf"\b{whole}\b", parts)
    return clean


def without_stop_words(tokens: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(list(stop_words)))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` tokens joined by spaces, repeats included."""

    def of(n: int) -> Column:
        if n == 1:
            return tokens
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    return F.concat(*[of(n) for n in range(low, high + 1)]) if high > low else of(low)


def inverted_index_to_text(index: str) -> Column:
    """Text of the map column ``index`` (word -> positions).

    Gaps become further spaces, the later key wins a shared position, and an
    index of fewer than two words or null gives null.
    """
    # transform over a one-element array binds a name, so that the sorted list is made once
    return F.expr(f"""
    case when size({index}) > 1 then
      get(transform(
        array(array_sort(flatten(transform(map_entries({index}), (e, k) -> transform(e.value, p -> named_struct('p', p, 'k', -k, 'w', e.key)))))),
        s -> get(transform(
          array(filter(s, (e, i) -> i = 0 or e.p <> get(s, i - 1).p)),
          a -> array_join(transform(a, (e, i) -> concat(repeat(' ', e.p - if(i = 0, 0, get(a, i - 1).p)), e.w)), '')), 0)), 0)
    end""")


def last_position(index: Column) -> Column:
    return F.array_max(F.flatten(F.map_values(index)))
