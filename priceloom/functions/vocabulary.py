"""Words by which attributes are told from text, for both stores.

Fixed values: groups are tried in this order and the first with a word in the text gives its label.
"""

USE_A = [
    ("Yeso-cartón (Volcanita / Drywall)", ["yeso-carton", "yeso carton", "volcanita", "drywall", "yesocarton"]),
    ("Metal (Metalcon / Perfiles)", ["metalcon", "perfil", "tabiqueria", "hojalateria", "metal"]),
    ("Madera (Aglomerado / MDF / Melamina)", ["aglomerado", "mdf", "melamina", "pino", "madera", "cholguan", "terciado"]),
    ("Techumbre (Techo / Zinc / Calamina)", ["techo", "techumbre", "zinc", "calamina", "v2", "v8", "tejado"]),
    ("Concreto (Hormigón / Ladrillo)", ["concreto", "hormigon", "ladrillo", "albañileria", "cemento"]),
    ("Fibrocemento (Internit / Pizarreño)", ["fibrocemento", "internit", "pizarreño"]),
]
USE_B = [
    ("Yeso-cartón (Volcanita / Drywall)", ["yeso-carton", "yeso carton", "volcanita", "vulcanita", "drywall", "yesocarton", "volc"]),
    ("Metal (Metalcon / Perfiles)", ["metalcon", "perfil", "tabiqueria", "hojalateria", "metal"]),
    ("Madera (Aglomerado / MDF / Melamina)", ["aglomerado", "mdf", "melamina", "pino", "madera", "cholguan", "terciado"]),
    ("Techumbre (Techo / Zinc / Calamina)", ["techo", "techumbre", "calamina", "v2", "v8", "tejado", "cubierta"]),
    ("Concreto (Hormigón / Ladrillo)", ["concreto", "hormigon", "ladrillo", "albañileria", "cemento"]),
    ("Fibrocemento (Internit / Pizarreño)", ["fibrocemento", "internit", "pizarreño"]),
]
TIP = [
    ("Autoperforante (Punta Broca)", ["autoperforante", "auto perforante", "punta broca", "autotaladrante"]),
    ("Punta Fina (Punta Espada / Clavo)", ["punta espada", "punta fina", "punta clavo", "aguja"]),
    ("Tirafondo (Madera Estructural)", ["tirafondo", "tira fondo", "perno madera"]),
]
HEAD_A = [
    ("Phillips (Cruz)", ["phillips", "cruz", "cruz phillips"]),
    ("Plana (Avellanada)", ["plana", "avellanada", "de hundir"]),
    ("Lenteja (Fijadora)", ["lenteja", "fijadora", "extra plana"]),
    ("Hexagonal (Copa)", ["hexagonal", "copa"]),
    ("Trompeta (Drywall)", ["trompeta", "bugle"]),
    ("Redonda (Pan head)", ["redonda", "pan head", "pan"]),
]
HEAD_B = [
    ("Phillips (Cruz)", ["phillips", "cruz", "cruz phillips", "ph2"]),
    ("Plana (Avellanada)", ["plana", "avellanada", "de hundir"]),
    ("Lenteja (Fijadora)", ["lenteja", "fijadora", "extra plana", "truss"]),
    ("Hexagonal (Copa)", ["hexagonal", "copa"]),
    ("Trompeta (Drywall)", ["trompeta", "bugle", "crs"]),
    ("Redonda (Pan head)", ["redonda", "pan head", "pan"]),
]
MATERIAL_A = [
    ("Acero Inoxidable (Inox)", ["inox", "inoxidable", "acero inox"]),
    ("Acero Zincado (Galvanizado)", ["zincado", "galvanizado", "zinc", "brillante"]),
    ("Acero Fosfatado (Negro / Empavonado)", ["empavonado", "fosfatado", "negro", "pavonado"]),
    ("Acero Bicromatado (Bronceado / Amarillo)", ["bronceado", "bicromatado", "amarillo"]),
    ("Acero Estándar", ["acero", "carbono"]),
]
MATERIAL_B = [
    ("Acero Inoxidable (Inox)", ["inox", "inoxidable", "acero inox"]),
    ("Acero Zincado (Galvanizado)", ["zincado", "galvanizado", "zinc", "brillante", "zc", "zbr", "zb"]),
    ("Acero Fosfatado (Negro / Empavonado)", ["empavonado", "fosfatado", "negro", "pavonado"]),
    ("Acero Bicromatado (Bronceado / Amarillo)", ["bronceado", "bicromatado", "amarillo", "iridiscente"]),
    ("Acero Estándar", ["acero", "carbono"]),
]

#: Labels of texts without any of the words.
DEFAULTS = {"uso": "Construcción general", "punta": "Punta Estándar", "cabeza": "Cabeza Estándar", "material": "Acero Estándar"}
#: Abbreviations that store B wants as whole words.
WHOLE_WORDS_B = ["zc", "zb", "zbr", "crs"]
#: Store B keeps products whose title holds one of these.
PRODUCT_WORDS = ["tornillo", "tirafondo", "soberbio", "autoperforante", "roscalata"]
NO_SIZE = "Medida no detectada"

GROUPS = {
    "a": {"uso": USE_A, "punta": TIP, "cabeza": HEAD_A, "material": MATERIAL_A},
    "b": {"uso": USE_B, "punta": TIP, "cabeza": HEAD_B, "material": MATERIAL_B},
}
WHOLE_WORDS = {"a": [], "b": WHOLE_WORDS_B}
