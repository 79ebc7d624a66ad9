"""Label names, word lists and keyword patterns that decide results."""

from __future__ import annotations

# The label set, in report order.
LABELS = ["qualité produit", "service livraison", "service client"]

# Topic-sheet spellings and the label they stand for.
CATEGORY_ALIASES = {
    "Qualité Produit": "qualité produit",
    "Qualité produit": "qualité produit",
    "Service Livraison": "service livraison",
    "Service livraison": "service livraison",
    "Service Client": "service client",
    "Service client": "service client",
}

# Decision thresholds in label order (trained model, then demo screen).
TRAINED_THRESHOLDS = [0.21, 0.44, 0.36]
SCREEN_THRESHOLDS = [0.26, 0.44, 0.23]

# Keyword patterns of "qualité produit".
PRODUCT_PATTERNS = [
    r"cass(é|ée|és|ées)?",
    r"casse(r)?",
    r"qualit(é|e|és|es|ées|ees)?(?!\s+de\s+(service|livraison|sav))",
    r"mati[èe]re(s)?",
    r"soli(de|d|de)?",
    r"résistan(t|ce|ces|t)?",
    r"correspond(ait|s|t)?",
    r"fonctionne(r)?",
    r"d[ée]f(ec)?tueu(se|s|e|x|ses)?",
    r"tiss(u|us|u)?(x)?",
    r"couleur(s|e)?",
    r"((trop|un peu|très)\s+(petit|grand)(e|es)?|taille(nt)?\s+(trop|un peu|très)?\s*(petit|grand)(e|es)?)",
    r"grand(e|es|s)?",
    r"ray(é|ee|ée|e|és|és|ees|ée|ure|ures)",
    r"finitions?",
    r"beau(x)?",
    r"belle(s)?",
    r"joli(e|es|s)?",
    r"conforme(s)?",
    r"en panne(s)?",
    r"bas de gamme",
    r"inutilisable(s)?",
]

# Keyword patterns of "service livraison".
DELIVERY_PATTERNS = [
    r"livr(é|er|aison|aisons|ées|ée|eur)?",
    r"passage(s)?",
    r"coli(s)?",
    r"paquet(s)?",
    r"carton(s)?",
    r"retard(é|ée|s)?",
    r"dpd",
    r"gls",
    r"poste",
    r"facteur(s)?",
    r"mondial relay",
    r"mondial relais",
    r"relais",
    r"relay",
    r"point relais",
    r"domicile",
    r"retrait",
    r"bureau de poste",
    r"ouvert(s|e|es)?",
    r"endommag(é|ée|és|ées)?",
    r"déposé(e|s)?",
    r"laisser?|laissé(e|s)?",
    r"transporteur(s)?",
    r"manquant(e|s)?",
    r"incomplet(s|es)?",
    r"abîmé(e|s)?",
    r"déchiré(e|s)?",
]

# Keyword patterns of "service client".
SUPPORT_PATTERNS = [
    r"service client(s)?",
    r"\bsav\b",
    r"service après vente",
    r"répond(re|s|u)?",
    r"réponse(s)?",
    r"rembour(s|ser|sement|sez)?",
    r"contact(er|e|es)?",
    r"mail(s)?|email(s)?",
    r"appel(er|s)?",
    r"incompétent(e|s|es)?",
    r"incompétence",
    r"escroc(s)?",
    r"arnaque(s)?",
    r"voleur(s|ses)?",
    r"solution(s)?",
    r"aucune réponse",
    r"réclamation(s)?",
    r"annul(é|ée|er|ation|ations)",
    r"litige(s)?",
    r"impossible[^.]{0,40}(joindre|contact(er|é|és)?|contacter)",
    r"qualité\s+de\s+(service|sav|service client)",
]

LABEL_PATTERNS = dict(zip(LABELS, [PRODUCT_PATTERNS, DELIVERY_PATTERNS, SUPPORT_PATTERNS]))

# Product words dropped before topic work.
PRODUCT_WORDS = [
    "montre", "montres", "boucle", "boucles", "oreilles", "oreille", "paire", "paires", "lunettes",
    "bracelet", "bracelets", "collier", "iphone", "téléphone", "pendentif", "robot", "robots",
    "aspirateur", "baskets", "basket", "chaussure", "chaussures", "sandales", "plantes", "plante",
    "arbres", "arbre", "bulbes", "willemse", "sommiers", "jardin", "bague", "lampe", "lampes",
    "abat-jour", "abat jour", "lampadaire", "parfum", "shampoing", "shampooing", "shampooings",
    "cheveux", "masque", "masques", "crème", "élastiques", "manteau", "bougie", "cadre", "écouteurs",
    "vélo", "robe", "vêtements", "bijoux", "sac", "portable", "clio", "luminaire", "oreillette",
    "induction", "écouteur", "couette", "samsung", "téléphones", "smartcase", "abat", "apple",
    "watch", "shirt", "tee", "chemise", "shirts", "hortensias", "orchidée", "sacs", "plant",
    "chaises", "lacoste", "polo", "pantalon", "jean", "jeans", "sneakers", "lunette", "écran",
    "tablette", "tablettes", "table", "tables", "chemisier", "pulls", "pull", "trotinettes",
    "trotinette", "chaussons", "chausson", "brosse", "brosses", "crèmes", "gel", "gels", "parfums",
    "robe", "robes", "sacoches", "sacoche", "vestes", "veste",
]

# Product words dropped by the letters-only topic cleaning.
TOPIC_CLEAN_WORDS = [
    "montre", "montres", "boucles", "oreilles", "oreille", "paire", "paires", "lunettes", "bracelet",
    "bracelets", "collier", "iphone", "téléphone", "pendentif", "robot", "robots", "aspirateur",
    "baskets", "basket", "chaussures", "sandales", "plantes", "plante", "arbres", "arbre", "bulbes",
    "willemse", "sommiers", "jardin", "bague", "lampe", "lampes", "abat-jour", "lampadaire", "parfum",
    "shampoing", "shampooing", "cheveux", "masque", "masques", "crème", "élastiques", "manteau",
    "bougie", "cadre", "écouteurs", "vélo",
]

# Topic ids of each class in the topic-group labelling.
TOPIC_GROUPS = {
    0: [3, 6, 18, 19, 23, 29],
    1: [5, 10, 24, 26, 27],
    2: [7, 8, 13, 14, 28],
}

# Upper edges and names of the text-length bins (right-closed; the last is open).
LENGTH_EDGES = [50, 100, 200, 500, 1000, 2000]
LENGTH_NAMES = ["<50", "50-100", "100-200", "200-500", "500-1000", "1000-2000", "2000+"]

# Season of each month.
SEASONS = {
    "Hiver": [12, 1, 2],
    "Printemps": [3, 4, 5],
    "Été": [6, 7, 8],
    "Automne": [9, 10, 11],
}

# Columns that are the same for every sentence of a review.
REVIEW_COLUMNS = [
    "Commentaire", "star", "date", "client", "reponse", "source", "company", "ville", "maj",
    "date_commande", "ecart", "clean_comment",
]
