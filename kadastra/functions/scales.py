"""Fixed values of the survey domain: scales, views, thresholds and word lists, as the results depend on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.functions.columns import fold

# Labels and scores of the Likert scales by scheme.
LIKERT = {
    "five": {
        "Très satisfait": 5, "Satisfait": 4, "Neutre": 3, "Peu satisfait": 2, "Très peu satisfait": 1,
        "Très bien entouré": 5, "Bien entouré": 4, "Moyennement entouré": 3, "Peu entouré": 2, "Très peu entouré": 1,
        "Très impliqué": 5, "Impliqué": 4, "Moyennement Impliqué": 3, "Peu impliqué": 2, "Très peu impliqué": 1,
    },
    "zero": {
        "Très peu satisfait": 0, "Peu satisfait": 1, "Neutre": 2, "Satisfait": 3, "Très satisfait": 4,
        "Très peu entouré": 0, "Peu entouré": 1, "Moyennement entouré": 2, "Bien entouré": 3, "Très bien entouré": 4,
        "Très peu impliqué": 0, "Peu impliqué": 1, "Moyenement impliqué": 2, "Impliqué": 3, "Très impliqué": 4,
        "Oui": 0, "Non": 1, "Jamais": 0, "Rarement": 1, "Souvent": 2, "Toujours": 3,
    },
    "folded": {
        "tres satisfait": 5, "tres satisfaite": 5, "satisfait": 4, "satisfaite": 4, "neutre": 3, "moyennement satisfait": 3, "moyennement satisfaite": 3,
        "peu satisfait": 2, "peu satisfaite": 2, "insatisfait": 1, "insatisfaite": 1, "tres peu satisfait": 1, "tres peu satisfaite": 1,
        "tres bien entoure": 5, "bien entoure": 4, "moyennement entoure": 3, "peu entoure": 2, "tres peu entoure": 1,
        "tres implique": 5, "implique": 4, "moyennement implique": 3, "peu implique": 2, "tres peu implique": 1,
    },
}

# Views by family, their dimensions in the order in which they are tried, and the least group size.
VIEWS = {
    "verbatims": {
        "age_range*profession": ("age_range", "profession"), "age_range*commune": ("age_range", "commune"), "profession*commune": ("profession", "commune"), "dimension*commune": ("dimension", "commune"),
        "dimension*age_range": ("dimension", "age_range"), "dimension*profession": ("dimension", "profession"), "age_range": ("age_range",), "profession": ("profession",), "commune": ("commune",), "dimension": ("dimension",),
    },
    "quantitative": {"age_range*profession": ("age_range", "profession"), "age_range*commune": ("age_range", "commune"), "profession*commune": ("profession", "commune"), "age_range": ("age_range",), "profession": ("profession",), "commune": ("commune",)},
    "survey": {
        "enquete_age_range*profession": ("age_range", "profession"), "enquete_age_range*commune": ("age_range", "commune"), "enquete_profession*commune": ("profession", "commune"),
        "enquete_age_range": ("age_range",), "enquete_profession": ("profession",), "enquete_commune": ("commune",), "enquete_global": (),
    },
    "survey_dimensions": {
        "enquete_dimension*commune": ("dimension", "commune"), "enquete_dimension*age_range": ("dimension", "age_range"), "enquete_dimension*profession": ("dimension", "profession"), "enquete_dimension": ("dimension",),
    },
    "interviews": {"entretien_commune": ("commune",)},
}
# The order in which the survey's views are tried.
SURVEY_ORDER = (
    "enquete_dimension*commune", "enquete_dimension*age_range", "enquete_dimension*profession", "enquete_age_range*commune", "enquete_profession*commune", "enquete_age_range*profession",
    "enquete_commune", "enquete_age_range", "enquete_profession", "enquete_dimension",
)
LEAST = {"verbatims": 3, "quantitative": 5, "survey": 2, "survey_dimensions": 3, "interviews": 5}

# Collections searched beside the views and the greatest distance of a hit in each.
COLLECTIONS = {
    "portrait_entretiens": 0.55, "raptor_entretiens_summaries": 0.55, "enquete_responses": 0.55, "enquete_scores_commune": 0.75, "communes_wiki": 0.60,
    "communes_equipements": 0.65, "communes_geo": 0.75, "zones_epci": 0.75, "communes_profil": 0.70,
}

# Columns of the survey that make up each dimension.
DIMENSIONS = {
    "Transports": ("Transports", "TransportsCommun", "ReseauRoutier", "Encombrement"), "Santé": ("Sante", "MedecinsGeneralistes", "AttenteRDV", "MedecinsSpecialistes"), "Éducation": ("Education",),
    "Logement": ("Logement",), "Revenus": ("Revenus",), "Emploi": ("SituationPro",), "Sécurité": ("Securite",), "Culture": ("Culture",), "Services de proximité": ("ServicesProximite",), "Réseau": ("Reseaux",),
    "Ratio vie pro/vie perso": ("EquilibreViePro",), "Communauté et relations": ("Entourage", "ImplicationLocale"), "Tourisme": ("Tourisme",), "Institutions": ("Institutions",),
}

# Word lists of question classes and of refusals.
WELLBEING = ("bien-être", "bien être", "bienetre", "bien-etre", "qualité de vie", "qualite de vie", "comment se porte", "comment vivent", "comment vit", "portrait global", "portrait de", "satisfaction globale", "conditions de vie")
PERCEPTION = (
    "ressenti", "ressentent", "ressent", "ressens", "perçoivent", "perçoit", "perception", "perceptions", "que pensent", "que pense", "avis des", "opinion", "témoignages", "verbatims", "verbatim",
    "enquête citoyenne", "enquete citoyenne", "comment vivent-ils", "comment vivent-elles", "comment les habitants", "comment les résidents", "comment les gens",
)
DIMENSION_RANKING = (
    "classement", "dimension la plus", "dimension la moins", "la plus faible", "la plus elevee", "la plus eleve", "le plus faible", "le plus eleve", "la note la plus", "la note la moins", "moins bien note", "mieux note",
    "meilleure dimension", "pire dimension", "quelle dimension", "quel score le plus", "toutes les dimensions", "comparaison des dimensions", "note la plus basse", "note la plus haute", "dimension obtient", "dimension recoit",
)
#: Words and patterns of further question classes. Patterns are looked for in the lower-cased text.
COMPARISON = ("compar", "moyenne", "reste", "île", "corse entiere", "corse entière")
QUANTITATIVE = ("indicateur", "statistique", "taux", "pourcentage", "nombre", "combien", "mesure", "chiffre", "données quantitatives", "questionnaire")
CROSS_ANALYSIS = (
    "pourquoi.*score", "pourquoi.*indicateur", "expliqu.*score", "expliqu.*indicateur", "corrélation", "lien entre", "rapport entre", "comment.*influenc", "impact.*sur", "caus.*de", "raison.*de",
    "pourquoi.*opp", "pourquoi.*chx", "pourquoi.*vec",
)
OFF_TOPIC = ("pib", "météo", "recette", "cuisine", "sport", "football", "histoire de france", "election nationale", "president", "impot", "bourse", "action", "crypto", "bitcoin")
SIMPLE = (
    "(quel est le score|quelle commune|score .{1,30}(ajaccio|bastia|corse|sartène|calvi|corte))", "(meilleure commune|commune .{1,20}meilleur|meilleur score|plus (haut|elevé|faible|bas))",
    "(ajaccio .{1,20}(supérieur|inférieur)|bastia .{1,20}(supérieur|inférieur))", "(quel rang|classement|quelle place|quelle est la commune)", r"(oppchovec|opp ?chovec|score .{1,20}bien-être)\s*(d'|de |a |à )\w",
)
#: Words for the professions of the survey, accents left out.
PROFESSIONS = [
    ("Étudiant(e)", ("etudiants", "etudiant", "etudiante", "etudiantes")), ("Salarié(e) – Cadre ou profession intermédiaire", ("cadres", "cadre", "professions intermediaires")),
    ("Salarié(e) – Employé(e)", ("employes", "employe", "employee", "employees", "salaries", "salarie")), ("Fonctionnaire", ("fonctionnaires", "fonctionnaire", "agents publics", "fonction publique")),
    ("Travailleur(se) indépendant(e) / Entrepreneur(e)", ("independants", "independant", "entrepreneurs", "entrepreneur", "auto-entrepreneurs")), ("Retraité(e)", ("retraites", "retraite", "retraitee", "retraitees")),
    ("Agriculteur(trice), artisan(e) ou commerçant(e)", ("agriculteurs", "agriculteur", "artisans", "artisan", "commercants", "commercant")), ("Sans emploi (en recherche d'emploi)", ("chomeurs", "chomeur", "demandeurs d'emploi", "sans emploi")),
]
GENDERS = [("F", ("femmes", "femme")), ("M", ("hommes", "homme"))]
REFUSALS = (
    "n'ai pas", "ne dispose pas", "pas de données", "pas d'information", "hors de ma", "non disponible", "aucune donnée", "ne couvre pas", "je ne suis pas en mesure", "impossible de répondre", "données limitées", "pas dans les sources",
)

RANKING = (
    "meilleur", "mieux", "meilleure", "mieux classé", "premier", "première", "premières", "premiers", "dernier", "dernière", "dernières", "derniers", "pire", "moins bon", "moins bonne",
    "classement", "classée", "classées", "classés", "top ", "rang ", "rang?", "quel rang", "mieux placé", "moins bien placé", "quelle commune", "quelles communes",
    "plus haut score", "plus bas score", "score le plus", "toutes les communes", "ensemble des communes", "comparer", "comparaison",
)
WHOLE = ("moyen", "moyenne", "general", "global", "ensemble", "niveau", "corse entiere", "ile entiere", "l ensemble", "toutes les communes", "score global", "score corse", "indicateur corse")
COMPONENTS = ("composante", "opp ", "cho ", "vec ", "sous-score", "sous score")
QUALITY = (
    "qualite de vie", "bien-etre", "satisfaction", "perception", "habitants", "vivent", "ressentent", "ressenti", "score", "indice", "note", "enquete", "opinion", "avis", "vecu", "conditions de vie", "problemes", "difficultes",
    "transports", "sante", "logement", "emploi", "securite", "education", "culture", "revenus", "services", "tourisme", "communaute", "relations", "institutions", "reseaux",
)

# Documents of the indicators that question classes get by id.
FIXED_DOCUMENTS = {"components": "oppchovec_classement_composantes", "whole": "oppchovec_aggregate_corse", "ranking": "oppchovec_classement_global", "method": "oppchovec_methodology"}

# Towns of the southern department, asked where a town has no text.
SOUTHERN_TOWNS = (
    "Ajaccio", "Afa", "Alata", "Bastelicaccia", "Albitreccia", "Grosseto-Prugna", "Porticcio", "Propriano", "Sartène", "Bonifacio", "Porto-Vecchio", "Lecci", "Zonza", "Levie", "Sollacaro",
    "Sarrola-Carcopino", "Cuttoli-Corticchiato", "Peri", "Valle-di-Mezzana", "Appietto", "Cauro", "Eccica-Suarella", "Coggia", "Cargèse", "Olmeto", "Pietrosella", "Viggianello", "Quenza", "Serra-di-Ferro",
    "Piana", "Osani", "Partinello", "Evisa", "Cristinacce", "Vico", "Soccia", "Orto", "Guagno", "Azzana", "Balogna", "Letia", "Renno", "Marignana", "Serriera", "Ota", "Calcatoggio",
    "Sari-Solenzara", "Conca", "Monacia-d'Aullène", "Figari", "Pianotolli-Caldarello", "Sotta", "San-Gavino-di-Carbini",
)


def likert_table(spark: SparkSession, scheme: str) -> DataFrame:
    """(label, score) of a scheme, for `encode_labels`."""
    return spark.createDataFrame(list(LIKERT[scheme].items()), "label string, score int")


def _has(text: Column, words: tuple[str, ...], folded: bool) -> Column:
    t = fold(text) if folded else F.lower(text)
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))


def asks_wellbeing(text: Column) -> Column:
    """Well-being questions, but not those that ask how it is felt."""
    return _has(text, WELLBEING, False) & ~_has(text, PERCEPTION, False)


def asks_dimension_ranking(text: Column) -> Column:
    return _has(text, DIMENSION_RANKING, True)


def asks_quality(text: Column) -> Column:
    return _has(text, QUALITY, True)


def indicator_documents(text: Column, n_towns: Column) -> Column:
    """Ids of the documents that a question gets by its class, in order: components, the whole, the ranking, and always the method."""
    components = asks_dimension_ranking(text) | _has(text, COMPONENTS, False)
    rules = [("components", components), ("whole", (n_towns == 0) & _has(text, WHOLE, True)), ("ranking", _has(text, RANKING, False)), ("method", F.lit(True))]
    return F.array_compact(F.array(*(F.when(test, F.lit(FIXED_DOCUMENTS[name])) for name, test in rules)))


def department(text: Column, name: Column) -> Column:
    """The department that a town's text names, else the north; for towns without a text by the list of southern ones."""
    t = F.lower(text)
    empty = text.isNull() | (text == "")
    south = F.contains(t, F.lit("corse-du-sud")) | F.contains(t, F.lit("corse du sud"))
    return F.when(empty, F.when(name.isin(*SOUTHERN_TOWNS), "CorseDuSud").otherwise("HauteCorse")).otherwise(F.when(south, "CorseDuSud").otherwise("HauteCorse"))


def is_refusal(answer: Column) -> Column:
    return _has(answer, REFUSALS, False)


def source_category(kind: Column, source_type: Column, view: Column) -> Column:
    """The category of a retrieved source; the first rule that holds decides."""
    t, st = F.coalesce(kind, F.lit("")), F.coalesce(source_type, F.lit(""))
    # The rules in their order.
    return (
        F.when((t == "raptor_summary") | (st == "raptor_portrait_summaries"), "raptor_portrait")
        .when((t == "raptor_enquete_summary") | (st == "raptor_enquete_summaries"), "raptor_enquete")
        .when(t == "classement_dimensions", "classement")
        .when(st == "enquete_scores_commune", "stats_enquete")
        .when(F.coalesce(view, F.lit("")) == "enquete_methodology", "methodology_enquete")
        .when((t == "methodology") | (st == "methodology"), "methodology_oppchovec")
        .when((t == "oppchovec_score") | st.isin("oppchovec_scores", "oppchovec_score"), "oppchovec")
        .when(st == "verbatim_evidence", "verbatims")
        .when(st.isin("communes_equipements", "communes_geo", "zones_epci") | (t == "zones_epci"), "equipements")
        .when(st == "communes_profil", "stats_repondants")
        .when(st.isin("entretiens", "portrait_entretiens", "raptor_entretiens_summaries"), "entretiens")
        .when(st == "enquete_responses", "stats_enquete")
        .otherwise("autre")
    )


def question_classes(text: Column) -> dict[str, Column]:
    """Booleans wellbeing, ranking, comparison, cross_analysis and quantitative, and complexity: out of domain, simple or complex.

    A question that names something out of the domain is that whatever else it asks. A null text is in no class and complex.
    """
    low = F.coalesce(F.lower(text), F.lit(""))
    return {
        "wellbeing": F.coalesce(asks_wellbeing(text), F.lit(False)), "ranking": F.coalesce(asks_dimension_ranking(text), F.lit(False)), "comparison": _has(low, COMPARISON, False),
        "cross_analysis": low.rlike("|".join(CROSS_ANALYSIS)), "quantitative": _has(low, QUANTITATIVE, False),
        "complexity": F.when(_has(low, OFF_TOPIC, False), "out of domain").when(low.rlike("|".join(SIMPLE)), "simple").otherwise("complex"),
    }

#: Indicators by the sign that names them, with their parts (sign, label, related words).
INDICATOR_PARTS = (
    ("opp", "Opportunités", (
        ("opp1", "Education", ("education", "diplome", "niveau scolaire")),
        ("opp2", "Diversité sociale", ("diversite", "mixite sociale", "inegalite")),
        ("opp3", "Transports", ("transport", "mobilite", "voiture", "bus")),
        ("opp4", "Technologies", ("technologie", "numerique", "internet", "communication")),
    )),
    ("cho", "Choix", (
        ("chx1", "Choix de logement", ("logement", "habitation", "residence")),
        ("chx2", "Choix emploi", ("emploi", "travail", "metier", "profession")),
    )),
    ("vec", "Vécu", (
        ("vec1", "Sécurité", ("securite", "insecurite", "peur", "danger")),
        ("vec2", "Environnement", ("environnement", "cadre de vie", "qualite", "pollution")),
        ("vec3", "Santé", ("sante", "medical", "hopital", "medecin")),
        ("vec4", "Social", ("social", "lien social", "communaute", "voisinage")),
    )),
)
