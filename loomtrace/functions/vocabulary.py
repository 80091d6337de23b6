"""Names of the triple store."""

# Prefixes and predicates.
PREFIXES = {
    "my": "http://my.graph/",
    "myf": "http://my.graph/file/",
    "wn": "http://wordnet-rdf.princeton.edu/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
}
LABEL, SUBCLASS, TYPE = "rdfs:label", "rdfs:subClassOf", "rdf:type"
DOC, PAGE, LANGUAGE, PARAGRAPH, SPAN, SENTENCE = "my:docID", "my:page_id", "my:language_id", "my:paraID", "my:spanID", "my:sentID"
SENTENCE_LABEL, CONTENT, VERB, SAME, SYNSET, CAN_BE, ABSTRACT = "my:sentLabel", "my:content", "my:verb", "my:same", "my:inSynset", "my:canBe", "dbo:abstract"
