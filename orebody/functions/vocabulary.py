"""Default vocabularies of the text classifier."""

from __future__ import annotations

# Phrase and weight of each signal, by axis and candidate.
MODES = {
    "didactic_teaching": [
        ("in other words", 2),
        ("that is to say", 2),
        ("note that", 1.5),
        ("remember that", 1.5),
        ("the key concept", 2),
        ("to understand", 1.5),
        ("this means that", 2),
        ("we say that", 2),
        ("is called", 1),
        ("refers to", 1),
        ("pedagogical", 3),
        ("tutorial", 2),
        ("lesson", 1.5),
        ("teaches", 1.5),
        ("understand", 0.5),
        ("i.e.", 1),
        ("for example", 0.8),
        ("such as", 0.5),
    ],
    "meta_descriptive_summary": [
        ("this section", 2),
        ("this chapter", 2),
        ("this document", 2),
        ("this paper", 2),
        ("this text", 2),
        ("this article", 2),
        ("the following", 1.5),
        ("an overview", 2.5),
        ("in summary", 2.5),
        ("to summarize", 2.5),
        ("in conclusion", 2),
        ("introduction to", 2),
        ("presents", 1),
        ("discusses", 1),
        ("explores", 1),
        ("examines", 1),
        ("outlines", 1.5),
        ("overview", 1.5),
        ("abstract", 1.5),
        ("summarizes", 2),
        ("describes", 0.8),
    ],
    "scholarly_annotation": [
        ("et al", 3),
        ("ibid", 3),
        ("as noted by", 2.5),
        ("according to", 2),
        ("as cited", 2.5),
        ("see also", 1.5),
        ("cf.", 2),
        ("op. cit.", 3),
        ("bibliography", 2),
        ("references", 1.5),
        ("literature", 1.5),
        ("cited in", 2),
        ("scholars", 1.5),
        ("academic", 1),
        ("peer-reviewed", 3),
        ("proceedings", 2),
        ("journal", 1.5),
        ("footnote", 2),
        ("endnote", 2),
        ("[1]", 1.5),
        ("[2]", 1.5),
        ("(2019)", 1),
        ("(2020)", 1),
        ("(2021)", 1),
        ("(2022)", 1),
        ("(2023)", 1),
        ("(2024)", 1),
    ],
    "transformational_dialogue": [
        ("q:", 3),
        ("a:", 3),
        ("question:", 2.5),
        ("answer:", 2.5),
        ("asked", 1.5),
        ("replied", 1.5),
        ("responded", 1.5),
        ("said to", 1.5),
        ("dialogue", 2),
        ("conversation", 2),
        ("you asked", 2.5),
        ("i asked", 2.5),
        ("interview", 2),
        ("exchange", 1),
        ("interlocutor", 3),
        ("inquired", 2),
    ],
    "functional_definition": [
        ("is defined as", 3),
        ("we define", 2.5),
        ("by definition", 2.5),
        ("let x be", 2),
        ("let us define", 2.5),
        ("denoted by", 2),
        ("denote", 1.5),
        ("formally,", 2.5),
        ("definition:", 3),
        ("def.", 2),
        (":=", 2.5),
        ("denotes", 1.5),
        ("we denote", 2.5),
        ("where x", 1.5),
        ("where the", 0.5),
        ("notation", 1.5),
        ("formula", 1),
    ],
}
POSTURES = {
    "doctrinal_assertion": [
        ("it is established", 3),
        ("it is proven", 3),
        ("it is true that", 2.5),
        ("the truth is", 2.5),
        ("it is known", 2.5),
        ("undeniably", 3),
        ("certainly", 1.5),
        ("must be", 1.5),
        ("always", 1),
        ("law of", 2),
        ("axiom", 2.5),
        ("principle of", 1.5),
        ("proven", 2),
        ("established", 1.5),
        ("fact", 1),
        ("necessarily", 1.5),
    ],
    "descriptive_abstract": [
        ("typically", 2),
        ("generally", 2),
        ("tends to", 2),
        ("often", 1.5),
        ("usually", 1.5),
        ("may be", 1.5),
        ("can be", 1),
        ("appears to", 2),
        ("seems to", 2),
        ("is thought to", 2.5),
        ("is believed to", 2.5),
        ("might be", 1.5),
        ("could be", 1.5),
        ("in many cases", 2),
        ("in general", 2),
        ("for the most part", 2),
    ],
    "externally_referenced": [
        ("according to", 2.5),
        ("as stated by", 2.5),
        ("as cited in", 2.5),
        ("studies show", 2.5),
        ("research indicates", 2.5),
        ("the literature suggests", 3),
        ("evidence suggests", 2.5),
        ("findings show", 2.5),
        ("data shows", 2.5),
        ("surveys indicate", 2.5),
        ("reports indicate", 2),
        ("as per", 1.5),
        ("sources say", 2),
        ("experts say", 2),
        ("research shows", 2.5),
    ],
    "experiential_reframing": [
        ("in my experience", 3),
        ("from my perspective", 3),
        ("in my view", 2.5),
        ("i have found", 2.5),
        ("i noticed", 2),
        ("i believe", 1.5),
        ("personally,", 2.5),
        ("looking at this differently", 3),
        ("from another angle", 2.5),
        ("reframing", 3),
        ("reconsidering", 2),
        ("in my own", 2),
        ("my understanding", 2.5),
        ("subjectively", 2.5),
        ("experientially", 3),
        ("i find that", 2),
    ],
    "conditional_revelation": [
        ("if we assume", 3),
        ("assuming that", 2.5),
        ("given that", 2),
        ("provided that", 2.5),
        ("under the condition", 3),
        ("in the case where", 2.5),
        ("were we to", 2.5),
        ("suppose that", 2.5),
        ("imagine that", 2),
        ("only if", 2),
        ("unless", 1.5),
        ("if and only if", 3),
        ("if x then", 2.5),
        ("if consciousness", 2.5),
        ("if quantum", 2.5),
        ("then we", 1.5),
        ("it follows that", 2),
    ],
}
TOPICS = {
    "consciousness_philosophy": [
        ("consciousness", 3),
        ("qualia", 4),
        ("subjective experience", 3.5),
        ("phenomenal", 3),
        ("sentience", 3),
        ("self-awareness", 3),
        ("awareness", 2),
        ("hard problem", 3.5),
        ("mind-body", 3),
        ("intentionality", 3),
        ("phenomenology", 3.5),
        ("perception", 1.5),
        ("conscious", 2),
    ],
    "quantum_mechanics": [
        ("quantum", 3),
        ("entanglement", 4),
        ("superposition", 4),
        ("wave function", 4),
        ("photon", 3),
        ("electron", 2.5),
        ("planck", 3.5),
        ("uncertainty principle", 4),
        ("bohr", 3),
        ("schrodinger", 4),
        ("heisenberg", 3.5),
        ("quantum mechanics", 4),
        ("quantum physics", 4),
        ("wave-particle", 4),
    ],
    "mathematics": [
        ("theorem", 3),
        ("proof", 2.5),
        ("equation", 2.5),
        ("formula", 2),
        ("matrix", 2.5),
        ("calculus", 3),
        ("algebra", 3),
        ("derivative", 3),
        ("integral", 2.5),
        ("manifold", 3.5),
        ("topology", 3),
        ("eigenvalue", 4),
        ("polynomial", 3),
        ("convergence", 2.5),
    ],
    "computer_science": [
        ("algorithm", 2.5),
        ("data structure", 3.5),
        ("machine learning", 3.5),
        ("neural network", 3.5),
        ("software", 2),
        ("programming", 2.5),
        ("database", 2.5),
        ("cpu", 3),
        ("compiler", 3),
        ("runtime", 2.5),
        ("recursion", 3),
        ("complexity", 2),
        ("binary", 2),
    ],
    "philosophy": [
        ("epistemology", 4),
        ("ontology", 4),
        ("metaphysics", 4),
        ("ethics", 2.5),
        ("phenomenology", 3.5),
        ("dialectic", 3.5),
        ("hermeneutics", 4),
        ("teleology", 4),
        ("being", 1),
        ("truth", 1),
        ("knowledge", 1),
        ("rationalism", 3.5),
        ("empiricism", 3.5),
    ],
    "biology": [
        ("cell", 2),
        ("organism", 2.5),
        ("dna", 3.5),
        ("protein", 3),
        ("evolution", 2.5),
        ("gene", 3),
        ("species", 2),
        ("metabolism", 3.5),
        ("neural", 2.5),
        ("neuron", 3),
        ("enzyme", 3.5),
        ("chromosome", 4),
        ("mitosis", 4),
    ],
    "history": [
        ("century", 2),
        ("war", 1.5),
        ("empire", 2.5),
        ("civilization", 2.5),
        ("ancient", 2),
        ("medieval", 3),
        ("revolution", 2),
        ("dynasty", 3),
        ("historical", 2.5),
        ("circa", 3),
        ("b.c.", 3),
        ("a.d.", 2.5),
        ("archaeological", 3.5),
    ],
    "theology": [
        ("god", 2),
        ("divine", 2.5),
        ("spiritual", 2),
        ("sacred", 2.5),
        ("prayer", 3),
        ("faith", 2),
        ("soul", 2),
        ("transcendent", 3),
        ("mystical", 3),
        ("salvation", 3.5),
        ("scripture", 3.5),
        ("theological", 3.5),
        ("heresy", 3.5),
    ],
    "psychology": [
        ("behavior", 2),
        ("cognitive", 2.5),
        ("emotional", 2),
        ("anxiety", 2.5),
        ("depression", 2.5),
        ("personality", 2.5),
        ("unconscious", 3),
        ("freud", 3.5),
        ("jung", 3.5),
        ("trauma", 2.5),
        ("psychotherapy", 3.5),
        ("attachment", 2.5),
        ("cognitive bias", 3.5),
    ],
    "linguistics": [
        ("grammar", 2.5),
        ("syntax", 3),
        ("semantics", 3),
        ("phonology", 4),
        ("morpheme", 4),
        ("phoneme", 4),
        ("discourse", 2.5),
        ("pragmatics", 3.5),
        ("lexicon", 3),
        ("etymology", 3.5),
        ("dialect", 3),
        ("language acquisition", 3.5),
    ],
}
LABEL_KEYWORDS = {
    "quantum_mechanics": ["quantum", "entanglement", "superposition", "bohr", "schrodinger", "heisenberg", "planck"],
    "consciousness_philosophy": ["consciousness", "qualia", "phenomenal", "sentience", "mind", "awareness"],
    "mathematics": ["math", "theorem", "algebra", "calculus", "geometry", "topology"],
    "computer_science": ["computer", "algorithm", "software", "code", "neural", "machine learning"],
    "philosophy": ["philosophy", "epistemology", "ontology", "metaphysics", "ethics"],
    "biology": ["biology", "cell", "dna", "evolution", "organism", "gene"],
    "history": ["history", "historical", "ancient", "medieval", "empire", "century"],
    "theology": ["theology", "god", "divine", "spiritual", "sacred", "religion"],
    "psychology": ["psychology", "cognitive", "behavior", "freud", "jung", "therapy"],
    "linguistics": ["linguistics", "grammar", "syntax", "semantics", "phonology", "morpheme"],
}
# End of fixed values.

DEFAULT = {"mode": MODES, "posture": POSTURES, "topic": TOPICS}
