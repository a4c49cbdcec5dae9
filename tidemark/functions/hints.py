"""Keywords that hint at the category of a post."""

from __future__ import annotations

#: Fixed values, which must be these for the right categories: the first category with a keyword in the
#: lower-cased text counts, so keywords with capitals never do.
CATEGORIES = {
    "identity-attack": ["tranny", "faggot", " fag ", "retard", "kike", "bitch", "whore", "slut", "groomer"],
    "dehumanization": ["subhuman", "vermin", "parasite", "infestation", "scum", "filth", "roach"],
    "counter-speech": ["punch a nazi", "punch nazis", "fuck nazis", "fuck terfs", "TERF"],
    "reclamation": ["queer pride", "trans rights", "fat liberation", "fat positive", "my fat body", "we queer"],
    "news-commentary": ["shooting", "stabbing", "murdered", "attack at", "police killed", "school shooter"],
    "concern-troll": ["just asking", "just sayin", "have you considered", "for your own good", "i worry that", "I worry", "not gonna lie"],
    "coded-sarcasm": ["oh sure", "yeah right", "totally normal", "very cool"],
    "dogpile": ["ratio", "we all", "everyone agrees", "consensus"],
    "disagreement": ["i disagree", "actually,", "wrong because", "respectfully disagree"],
    "support": ["love you", "proud of", "you matter", "we got you", "with you", "rooting for"],
}
