"""SQL of the stemmed full-text search: the word forms that share a stem in the driver's documents stand for a stemmer."""

from __future__ import annotations

LEX = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
FORMS = {
    "rewh": "rewh rewhed rewhes rewhing rewhly rewhlyed rewhlying rewhingly",
    "edon": "edon edonly edoning edoner edoned edones",
    "hehe": "hehe hehely hehees heheed heheing",
    "ater": "ater aterer atered atering aterly ateres",
}
#: The same as a dictionary: queries whose SQL lists the forms take no others for these lexemes.
CLOSED = {stem: frozenset(forms.split()) for stem, forms in FORMS.items()}
STEM = "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(f) for f in forms.split())}) THEN '{stem}'" for stem, forms in FORMS.items()) + " END"
PLACES = f"""p AS (SELECT doc_id, i, {STEM} AS k FROM (SELECT doc_id, unnest({LEX}) AS w, generate_subscripts({LEX}, 1) AS i FROM documents)), hits AS (SELECT * FROM p WHERE k IS NOT NULL)"""


def covers(a: str, b: str) -> str:
    """(doc_id, r), the cover density of two lexemes: neighbouring hits of different lexemes are the covers."""
    return f"""SELECT doc_id, sum(0.1 / (i - pi)) AS r FROM (SELECT doc_id, i, k, lag(i) OVER w AS pi, lag(k) OVER w AS pk FROM hits WHERE k IN ('{a}', '{b}') WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE k <> pk GROUP BY 1"""


#: The ``fts`` stream of the question ``rewhing edon``.
STREAM = f"""{PLACES}, fts AS (SELECT doc_id, row_number() OVER (ORDER BY round(r, 9) DESC, doc_id) AS rank FROM ({covers('rewh', 'edon')}) QUALIFY rank <= 60)"""
