"""Lexicon relations, as plain tables. All entries are fixed values: results depend on each of them."""

from __future__ import annotations

# Positive quantifier -> negative counterpart.
QUANTIFIER_SWAPS = {
    "some": "no", "all": "none of the", "every": "no", "each": "no", "both": "neither", "always": "never",
    "someone": "nobody", "somebody": "nobody", "everyone": "no one", "everybody": "nobody",
    "something": "nothing", "everything": "nothing", "somewhere": "nowhere", "everywhere": "nowhere",
    "sometimes": "never", "often": "never", "usually": "never",
}
# Quantified subjects with two scope readings.
SCOPE_BEARING = ["all", "every", "each", "everyone", "everybody", "everything", "both", "many", "most"]
# Negative adverb -> (subtype, intensity).
NEGATIVE_ADVERBS = {
    "never": ("absolute", "neutral"), "hardly": ("partial", "partial"), "barely": ("partial", "partial"), "rarely": ("partial", "partial"),
    "seldom": ("partial", "partial"), "scarcely": ("partial", "partial"),
}
# Negative prefixes, and the onsets that some of them need.
NEGATIVE_PREFIXES = ["un", "in", "im", "ir", "il", "non", "dis"]
PREFIX_ONSETS = {"im": "bmp", "ir": "r", "il": "l"}
# Overt cues.
EXPLICIT_CUES = [
    "not", "n't", "never", "no", "none", "nobody", "no-one", "noone", "nothing", "nowhere", "neither", "nor",
    "cannot", "cant", "without", "hardly", "barely", "rarely", "seldom", "scarcely",
]
# Words that carry negative polarity themselves.
LEXICALLY_NEGATIVE = [
    "impossible", "unlikely", "unable", "incapable", "unfit", "unclear", "invalid", "incorrect", "inaccurate",
    "inconsistent", "incomplete", "unavailable", "unsafe", "unstable", "unusual", "unhappy", "unfair", "irrelevant",
    "illegal", "illegible", "improbable", "imperfect", "insufficient", "unsuccessful", "unwilling", "unreliable",
    "unknown", "nonexistent", "dishonest", "useless", "hopeless", "harmless", "careless", "meaningless", "powerless",
    "worthless", "fruitless", "absent", "lacking", "devoid", "void", "empty", "missing", "fail", "fails", "failed",
    "lack", "lacks", "lacked", "refuse", "refuses", "refused", "deny", "denies", "denied", "neglect", "neglects",
    "neglected", "cease", "ceases", "ceased",
]
# Negative quantifier -> what an affirmation restores.
QUANTIFIER_FLIPS = {
    "no": "some", "none": "some", "neither": "both", "nobody": "somebody", "noone": "someone", "no-one": "someone",
    "nothing": "something", "nowhere": "somewhere", "nor": "or",
}
# Negative adverb -> replacements; the empty one deletes it.
ADVERB_AFFIRMATIONS = {
    "never": ["", "sometimes"], "rarely": ["", "often"], "seldom": ["", "often"], "hardly": [""], "barely": [""], "scarcely": [""],
}
# Two-word negative quantifiers.
QUANTIFIER_BIGRAMS = {("no", "one"): "someone"}
# Hedges and intensifiers as (text, slot, subtype, frames that they fit; none: any).
HEDGES = [
    ("maybe", "adverb", "maybe_not", []), ("possibly", "adverb", "possibly_not", []), ("probably", "adverb", "probably_not", []),
    ("might", "modal", "might_not", []), ("may", "modal", "may_not", []),
]
INTENSIFIERS = [
    ("surely", "adverb", "surely_not", []), ("definitely", "adverb", "definitely_not", []), ("certainly", "adverb", "certainly_not", []),
    ("absolutely", "adverb", "absolutely_not", []), ("not at all", "post_aux", "not_at_all", ["copula"]),
    ("by no means", "post_aux", "by_no_means", ["copula", "existing_aux"]),
]
# Implicit triggers as (lemma, frame, subtype, predicate), and what possession verbs turn into.
IMPLICIT_TRIGGERS = [
    ("fail", "to_inf", "fails_to", ""), ("refuse", "to_inf", "refuses_to", ""), ("neglect", "to_inf", "neglects_to", ""),
    ("cease", "to_inf", "ceases_to", ""), ("be", "copular", "is_unable_to", "unable"), ("deny", "gerund", "denies", ""),
]
LACK_TRIGGER = ("lack", "np", "lacks", "")
POSSESSION_VERBS = ["have", "possess", "contain", "include"]
# Contrastive frames, and privatives for `with` and for a rebuilt copula, as (phrase, subtype).
CONTRASTIVE_FRAMES = [("anything but", "anything_but"), ("far from", "far_from"), ("the opposite of", "the_opposite_of")]
WITH_REPLACEMENTS = [("without", "without"), ("in the absence of", "in_the_absence_of")]
COPULAR_PRIVATIVES = [("without", "without"), ("devoid of", "devoid_of"), ("free of", "free_of")]
# Heads of privatives, and those that need `of`.
PRIVATIVE_HEADS = ["without", "devoid", "free", "absence"]
PRIVATIVE_NEEDS_OF = ["devoid", "free", "absence"]
# Negative quantifiers.
NEGATIVE_QUANTIFIERS = ["no", "none", "neither", "nobody", "nothing", "nowhere", "nor", "noone", "no-one"]
# What an affirmation puts for an implicit negative, those that need a clause, and those that promote theirs.
IMPLICIT_SWAPS = {"refuse": "agree", "deny": "admit", "fail": "manage", "neglect": "remember", "cease": "continue", "forget": "remember"}
SWAPS_NEED_CLAUSE = ["refuse", "fail", "neglect", "cease", "forget"]
PROMOTE_ONLY = ["avoid"]
# Words with negative affixes that don't negate their stem, and nouns that take a negative prefix.
AFFIXAL_BLOCKLIST = ["invaluable", "inflammable", "disgruntled", "disorder", "immeasurably", "disarmament", "disappearance", "impersonal"]
NOUN_STEMS = [
    "ability", "accuracy", "advantage", "agreement", "comfort", "convenience", "efficiency", "equality", "honesty", "justice", "satisfaction",
    "security", "stability",
]
# Words that antonyms are not put for.
ANTONYM_VERB_STOPS = ["be", "have", "do", "get", "make", "take", "use", "go", "say", "see"]
ANTONYM_WORD_STOPS = ["other", "same", "such", "own", "certain"]
# Family of a cue -> group.
FAMILY_GROUPS = {
    "A_syntactic": "explicit", "B_quantifier": "explicit", "C_neg_adverb": "explicit", "H_hedged": "explicit", "I_intensified": "explicit",
    "D_affixal": "implicit", "E_antonym": "implicit", "F_implicit": "implicit", "G_prepositional": "implicit", "J_contrastive": "implicit",
    "K1_cancellation": "cancellation", "K2_compound": "compound", "L_scope_position": "other", "M_modal": "other", "CONTROL_paraphrase": "control",
}
# Weights of cue intensities and families.
INTENSITY_WEIGHT = {"hedged": 0.6, "neutral": 0.9, "intensified": 1.0, "partial": 0.4}
FAMILY_WEIGHT = {
    "A_syntactic": 1.0, "C_neg_adverb": 1.0, "B_quantifier": 1.0, "F_implicit": 0.8, "D_affixal": 0.7, "G_prepositional": 0.8, "J_contrastive": 0.8,
}
# Auxiliaries and determiners that the patterns below repeat.
_MODALS = "can|could|will|would|shall|should|may|might|must"
_DETERMINERS = "the|a|an|this|that|these|those"
# Surface patterns that reject a variant, in order; matched on lower case.
BLACKLIST = {
    "repeated_not": r"\bnot\s+not\b",
    "repeated_never": r"\bnever\s+never\b",
    "no_no": r"\bno\s+no\b",
    "do_plus_aux": rf"\b(?:do|does|did)\s+(?:not\s+)?(?:am|is|are|was|were|been|being|has|had|does|did|{_MODALS})\b",
    "stacked_modals": rf"\b(?:{_MODALS})\s+(?:not\s+)?(?:{_MODALS})\b",
    "stacked_copula": r"\b(?:is|are|was|were)\s+(?:not\s+)?(?:is|are|was|were)\b",
    "doubled_determiner": rf"\b(?:{_DETERMINERS})\s+(?:{_DETERMINERS})\b",
    "of_of": r"\bof\s+of\b",
    "to_to": r"\bto\s+to\b",
    "dangling_to": r"\bto\s*[.,;:!?]",
    "neg_stack_never_not": r"\bnever\s+not\b|\bnot\s+never\b",
    "hardly_not": r"\b(?:hardly|barely|rarely|seldom|scarcely)\s+not\b",
    "empty_predicate": r"\b(?:does|do|did)\s+not\s*[.,;:!?]?\s*$",
    "double_space_cue": r"\bnot\s+to\s*$",
}
# Auxiliary -> contracted negative where it is not the word with n't, and auxiliaries without one.
CONTRACTIONS = {"can": "can't", "will": "won't", "shall": "shan't"}
UNCONTRACTABLE = ["am", "may"]
# Negative auxiliaries in one word -> the bare auxiliary; stems that n't leaves -> the auxiliary.
NEGATIVE_AUX_BASES = {"cannot": "can", "can't": "can", "cant": "can", "won't": "will", "shan't": "shall"}
CONTRACTED_STEMS = {"ca": "can", "wo": "will", "sha": "shall"}
# Form of do -> tag of the verb that it stands before.
DO_FORM_TAGS = {"do": "VBP", "does": "VBZ", "did": "VBD"}
# Irregular verbs (lemma, past, participle).
IRREGULAR_VERBS = [
    ("be", "was", "been"), ("become", "became", "become"), ("begin", "began", "begun"), ("break", "broke", "broken"), ("bring", "brought", "brought"),
    ("build", "built", "built"), ("buy", "bought", "bought"), ("catch", "caught", "caught"), ("choose", "chose", "chosen"), ("come", "came", "come"),
    ("cost", "cost", "cost"), ("cut", "cut", "cut"), ("do", "did", "done"), ("draw", "drew", "drawn"), ("drive", "drove", "driven"),
    ("eat", "ate", "eaten"), ("fall", "fell", "fallen"), ("feed", "fed", "fed"), ("feel", "felt", "felt"), ("fight", "fought", "fought"),
    ("find", "found", "found"), ("forget", "forgot", "forgotten"), ("get", "got", "gotten"), ("give", "gave", "given"), ("go", "went", "gone"),
    ("grow", "grew", "grown"), ("have", "had", "had"), ("hear", "heard", "heard"), ("hide", "hid", "hidden"), ("hit", "hit", "hit"),
    ("hold", "held", "held"), ("keep", "kept", "kept"), ("know", "knew", "known"), ("lead", "led", "led"), ("leave", "left", "left"),
    ("lend", "lent", "lent"), ("let", "let", "let"), ("lose", "lost", "lost"), ("make", "made", "made"), ("mean", "meant", "meant"),
    ("meet", "met", "met"), ("pay", "paid", "paid"), ("put", "put", "put"), ("read", "read", "read"), ("rise", "rose", "risen"),
    ("run", "ran", "run"), ("say", "said", "said"), ("see", "saw", "seen"), ("sell", "sold", "sold"), ("send", "sent", "sent"),
    ("set", "set", "set"), ("show", "showed", "shown"), ("shut", "shut", "shut"), ("sing", "sang", "sung"), ("sit", "sat", "sat"),
    ("sleep", "slept", "slept"), ("speak", "spoke", "spoken"), ("spend", "spent", "spent"), ("stand", "stood", "stood"), ("take", "took", "taken"),
    ("teach", "taught", "taught"), ("tell", "told", "told"), ("think", "thought", "thought"), ("throw", "threw", "thrown"),
    ("understand", "understood", "understood"), ("wear", "wore", "worn"), ("win", "won", "won"), ("write", "wrote", "written"),
]
# Modal -> modality.
MODALITY = {
    "can": "ability", "could": "ability", "may": "epistemic", "might": "epistemic", "will": "epistemic", "would": "epistemic",
    "shall": "deontic", "should": "deontic", "must": "deontic", "ought": "deontic", "need": "deontic",
}
# Readings of a negated modal as (modal, surface, subtype, reading, modality).
MODAL_READINGS = [
    ("must", "must not", "must_not_prohibition", "prohibition", "deontic"),
    ("must", "need not", "need_not_absence_of_obligation", "absence_of_obligation", "deontic"),
    ("should", "should not", "should_not_prohibition", "prohibition", "deontic"),
    ("should", "need not", "need_not_absence_of_obligation", "absence_of_obligation", "deontic"),
    ("can", "cannot", "cannot_ability_denied", "ability_denied", "ability"),
    ("can", "may not", "may_not_permission_denied", "permission_denied", "deontic"),
    ("may", "may not", "may_not_permission_denied", "permission_denied", "deontic"),
    ("may", "might not", "might_not_possibility_denied", "possibility_denied", "epistemic"),
]
# Antonyms that pair rules know besides a word net's.
CURATED_ANTONYMS = [
    ("alive", "dead"), ("present", "absent"), ("include", "exclude"), ("same", "different"), ("right", "incorrect"), ("wrong", "correct"),
    ("hard", "easy"), ("important", "insignificant"), ("important", "noncrucial"), ("serious", "playful"), ("large", "tiny"),
    ("increase", "diminish"), ("increase", "decline"), ("continue", "stop"), ("cause", "prevent"), ("broad", "narrow"), ("sure", "uncertain"),
    ("true", "untruthful"), ("predecessor", "successor"), ("stupid", "intelligent"), ("open", "covert"), ("rarely", "commonly"),
    ("seldom", "commonly"), ("manageable", "difficult"), ("establish", "discontinue"), ("significant", "slight"),
]


def prefixed_antonyms() -> list[tuple[str, str, str]]:
    """(lemma, part of speech, antonym) of adjectives among the lexical negatives and the stems that their affixes leave."""
    out = []
    for word in LEXICALLY_NEGATIVE:
        for prefix in NEGATIVE_PREFIXES:
            if word.startswith(prefix) and len(word) > len(prefix) + 3 and (prefix not in PREFIX_ONSETS or word[len(prefix)] in PREFIX_ONSETS[prefix]):
                out.append((word[len(prefix) :], "ADJ", word))
        if word.endswith("less"):
            out.append((word[:-4] + "ful", "ADJ", word))
    return out


def surface_cues() -> list[str]:
    """Cues with regular endings: a base list times the endings of English inflection."""
    triggers = [t[0] for t in IMPLICIT_TRIGGERS if t[0] != "be"] + [t[3] for t in IMPLICIT_TRIGGERS if t[3]] + [LACK_TRIGGER[0]]
    base = dict.fromkeys(["not", "cannot", "no", "nt", *NEGATIVE_ADVERBS, *NEGATIVE_QUANTIFIERS, *QUANTIFIER_FLIPS, *PRIVATIVE_HEADS, *LEXICALLY_NEGATIVE, *triggers])
    return sorted({w + s for w in base for s in ("", "s", "es", "ed", "d", "ing")})
