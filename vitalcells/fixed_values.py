"""Values that results must share with the published analysis."""

# Columns read from every yearly file.
COLUMNS = (
    "CODMUNRES", "RACACORMAE", "SEMAGESTAC", "ESCMAE", "ESCMAE2010", "IDADEMAE", "DTNASC",
    "CONSULTAS", "QTDFILVIVO", "ESTCIVMAE", "GRAVIDEZ", "MESPRENAT",
)
NUMERIC_COLUMNS = (
    "RACACORMAE", "SEMAGESTAC", "ESCMAE", "ESCMAE2010", "IDADEMAE",
    "CONSULTAS", "QTDFILVIVO", "ESTCIVMAE", "GRAVIDEZ", "MESPRENAT",
)

# Columns profiled per year, and the code that means "unknown" where there is one.
PROFILED = (
    "SEMAGESTAC", "GESTACAO", "RACACORMAE", "IDADEMAE", "ESCMAE", "ESCMAE2010", "DTNASC",
    "CODMUNRES", "CONSULTAS", "CONSPRENAT", "MESPRENAT", "QTDFILVIVO", "ESTCIVMAE", "GRAVIDEZ",
)
UNKNOWN_CODE = {
    "RACACORMAE": "9", "ESCMAE": "9", "ESCMAE2010": "9", "ESTCIVMAE": "9", "CONSULTAS": "9",
    "GRAVIDEZ": "9", "GESTACAO": "9", "MESPRENAT": "99", "QTDFILVIVO": "99", "CONSPRENAT": "99",
}

# The study window, its last year and its period blocks.
YEARS = (2015, 2024)
PERIODS = {
    "Pre-pandemia(2015-2019)": (2015, 2019),
    "Pandemia(2020-2022)": (2020, 2022),
    "Pos-pandemia(2023-2024)": (2023, 2024),
}

# State codes of the country and their macro-regions.
STATES = {
    "Norte": {"11": "RO", "12": "AC", "13": "AM", "14": "RR", "15": "PA", "16": "AP", "17": "TO"},
    "Nordeste": {"21": "MA", "22": "PI", "23": "CE", "24": "RN", "25": "PB", "26": "PE",
                 "27": "AL", "28": "SE", "29": "BA"},
    "Sudeste": {"31": "MG", "32": "ES", "33": "RJ", "35": "SP"},
    "Sul": {"41": "PR", "42": "SC", "43": "RS"},
    "Centro-Oeste": {"50": "MS", "51": "MT", "52": "GO", "53": "DF"},
}
FOCUS_REGION = "Centro-Oeste"

# Code labels. The first label of an ordered list is the reference level.
RACE = {1: "Branca", 2: "Preta", 4: "Parda", 5: "Indigena"}
RACE_LEVELS = ("Branca", "Parda", "Preta", "Indigena")
RACE_REFERENCE = "Branca"
RACE_FOCAL = "Indigena"
RACE_OTHER_CODE = 3
RACE_PROFILE = {"1": "Branca", "2": "Preta", "3": "Amarela", "4": "Parda", "5": "Indígena",
                "9": "Ignorado"}
PLURALITY_PROFILE = {"1": "Única", "2": "Dupla", "3": "Tripla+", "9": "Ignorado"}
AGE_LEVELS = ("20-34", "<20", ">=35")
EDUCATION = {1: "Nenhuma", 2: "1-3anos", 3: "4-7anos", 4: "8-11anos", 5: "12mais"}
EDUCATION_2010 = {0: "0_Sem", 1: "1_FundI", 2: "2_FundII", 3: "3_Medio", 4: "4_SupInc",
                  5: "5_SupComp"}
VISITS = {1: "None", 2: "1-3", 3: "4-6", 4: "7plus", 9: "Ignorado"}
PARITY_LEVELS = ("0", "1", "2", "3", "Ign")
PARITY_UNKNOWN = 99
MARITAL_UNKNOWN = 9
WEEKS_VALID = (22, 44)
AGE_VALID = (10, 60)
PRETERM_WEEKS = 37

# Names of the cascade steps.
STEP_NAMES = (
    "0_CO_bruto", "1_raca_valida(excl Amarela/null)", "2_SEMAGESTAC 22-44 nao-missing",
    "3_{edu} presente", "4_IDADEMAE 10-60", "5_ano/UF/municipio presente",
    "6_sensib(+cons,parid,estciv)",
)

# Model names and the factor each one adds to the one before.
LADDER = (
    ("M1_Crude", "raca"), ("M2_+Idade", "idade_cat"), ("M3_+Esc", "esc_cat"),
    ("M4_+Ano", "ano_cat"), ("M5_PRIMARY", "uf_cat"), ("M6_+Prenat", "cons_cat"),
    ("M7_+Paridade", "parid_cat"), ("M8_FULL", "estciv_cat"),
)
LAST_PRIMARY_MODEL = "M5_PRIMARY"

# Focal odds ratios published for the variant cohort.
PUBLISHED_FOCAL_OR = {"M1": 1.781, "M5": 1.588, "M6": 1.322, "M7": 1.322, "M8": 1.322}

# Row labels of the missing-by-variable table.
MISSING_LABELS = {
    "SEMAGESTAC": "Idade gestacional", "RACACORMAE": "Raca/cor materna",
    "IDADEMAE": "Idade materna", "ESCMAE": "Escolaridade",
    "CONSULTAS": "No consultas pre-natal", "MESPRENAT": "Mes inicio pre-natal",
    "QTDFILVIVO": "Paridade", "ESTCIVMAE": "Estado civil", "CODMUNRES": "Municipio residencia",
}

# Roles of the variable dictionary.
ROLES = (
    ("Desfecho (IG semanas)", "SEMAGESTAC"), ("Exposição (raça/cor mãe)", "RACACORMAE"),
    ("Covariável: idade", "IDADEMAE"), ("Covariável: escolaridade", "ESCMAE"),
    ("Tempo: ano nasc.", "DTNASC"), ("Cluster: município resid.", "CODMUNRES"),
    ("Sens.: nº consultas pré-natal", "CONSULTAS"), ("Sens.: início pré-natal", "MESPRENAT"),
    ("Sens.: paridade", "QTDFILVIVO"), ("Sens.: estado civil", "ESTCIVMAE"),
    ("Sens.: tipo gravidez", "GRAVIDEZ"),
)

# Phrases for the relevance scan.
KEYWORDS = (
    "clima e saúde", "mudanças climáticas", "saúde materno-infantil", "saúde perinatal",
    "mortalidade materna", "prematuridade", "SINASC", "SIM", "DATASUS", "séries temporais",
    "DLNM", "disparidades raciais", "equidade em saúde", "populações migrantes",
    "saúde digital", "health tech", "inteligência artificial em saúde", "auditoria médica",
    "aplicativos de saúde", "inovação", "startup", "subvenção econômica", "epidemiologia",
    "saúde pública",
)
TIERS = ("Alta", "Média", "Baixa")
