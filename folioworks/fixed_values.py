"""Limits, name sets, namespaces and output wording.

Results are compared with these literally, so they are kept as plain text and
in one place.  Wording is written as ``format_string`` patterns.
"""

# Limits.
MAX_DIMENSION = 1600
JPEG_QUALITY = 80
MIN_PART_BYTES = 204_800
ALERT_BYTES = 104_857_600
MIN_COLORS = 4096
SAMPLE_SIDE = 512
MIN_SAVING = 0.05
COPY_BLOCK = 4 * 1024 * 1024

# Names inside a package.
MEDIA_PREFIX = "word/media/"
CONTENT_TYPES_PART = "[Content_Types].xml"
MAIN_PART = "word/document.xml"
ROOT_RELS = "_rels/.rels"
RELS_SUFFIX = ".rels"
JPEG_EXTENSIONS = (".jpg", ".jpeg", ".jpe", ".jfif")
PNG_EXTENSIONS = (".png",)
VECTOR_EXTENSIONS = (".emf", ".wmf", ".svg", ".wdp")

# Package XML.
NS_CONTENT_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
NS_RELATIONSHIPS = "http://schemas.openxmlformats.org/package/2006/relationships"
IMAGE_REL_TYPE = (
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships/image"
)
DOCUMENT_REL_TYPE = (
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
)

# Codes whose readings arrive multiplied by ten.
TENTHS_CODES = (
    "dew_point_temp",
    "feellike_temp",
    "heat_index",
    "rain_1h",
    "rain_24h",
    "rain_rate",
    "temp_current",
    "temp_current_external",
    "temp_current_external_1",
    "temp_current_external_2",
    "temp_current_external_3",
    "windchill_index",
    "windspeed_avg",
    "windspeed_gust",
)
STAMP_COLUMN = "timestamp"
STAMP_PATTERN = "yyyy-MM-dd HH:mm:ss"

# Why a part is kept.
KEPT_VECTOR = "vetorial (mantida)"
KEPT_EXTENSION = "extensão %s (mantida)"
KEPT_SMALL = "%d KB < %d KB (mantida)"
KEPT_FORMAT = "formato %s (mantida)"
KEPT_MISMATCH = "extensão não confere com o conteúdo (mantida)"
KEPT_NOT_SMALLER = "recompressão ficou maior (original mantida)"
KEPT_ERROR = "erro ao processar (%s) — mantida"
KEPT_NOT_PNG = "conteúdo não é PNG (%s) — mantida"
KEPT_ALPHA = "possui transparência real (mantida como PNG)"
KEPT_FEW_COLORS = "poucas cores — parece logo/diagrama (mantida como PNG)"
KEPT_NOT_ENOUGH = "conversão não reduziu o suficiente (mantida como PNG)"
KEPT_ERROR_PNG = "erro ao processar (%s) — mantida como PNG"
UNKNOWN_FORMAT = "desconhecido"

# What a proof can find.
BAD_CHECKSUM = "ZIP gerado corrompido (testzip falhou)"
BAD_MEMBERS = "lista de membros do ZIP difere do original"
BAD_MEDIA_COUNT = "nº de imagens difere: %d vs %d"
BAD_PART = "parte não-imagem alterada: %s"
BAD_COUNTS = (
    "contagens diferem: parágrafos %d vs %d, tabelas %d vs %d, imagens inline %d vs %d"
)
BAD_MEMBERS_RENAMED = "lista de membros do ZIP inesperada. Faltando: %s Sobrando: %s"
BAD_PART_RENAMED = "parte alterada indevidamente: %s"
BAD_MEDIA_COUNT_RENAMED = "nº de imagens em word/media difere: %d vs %d"
BAD_NEW_IMAGE = "JPEG convertido corrompido: %s"
BAD_REL_IDS = "conjunto de Ids de relacionamento mudou"
BAD_REL_TYPE = "relacionamento %s: Type/TargetMode alterado"
BAD_REL_NOT_IMAGE = "relacionamento %s: Target alterado em relacionamento não-imagem"
BAD_REL_NOT_RENAMED = "relacionamento %s: Target alterado sem conversão correspondente"
BAD_REL_TARGET = "relacionamento %s: novo Target inesperado (%s)"
BAD_DEFAULT_LOST = "um Default existente foi removido"
BAD_DEFAULT_ADDED = "Default(s) inesperado(s) adicionado(s): %s"
BAD_OVERRIDE_LOST = "Override(s) removido(s) indevidamente: %s"
BAD_OVERRIDE_ADDED = "Override(s) inesperado(s) adicionado(s)"
BAD_OVERRIDE_TYPE = "ContentType de %s alterado"
MISSING_CONTENT_TYPES = "[Content_Types].xml ausente — não é um .docx válido"

# Report lines.
RULE_LINE = "=" * 78
REPORT_TITLE = "LOG DE REDUÇÃO DE .DOCX"
REPORT_TITLE_2 = "LOG DA 2ª PASSADA — CONVERSÃO PNG -> JPEG"
REPORT_PARAMETERS = "Parâmetros: máx. %d px | JPEG q=%d | mínimo %d KB"
REPORT_PARAMETERS_2 = (
    "Parâmetros: JPEG q=%d | mínimo %d KB | mín. %d cores distintas para considerar "
    "'fotográfico' | redução mínima exigida: %.0f %%"
)
LINE_FILE = "ARQUIVO: %s"
LINE_BEFORE = "  Tamanho antes:  %s"
LINE_BEFORE_2 = "  Tamanho antes: %s"
LINE_AFTER = "  Tamanho depois: %s"
LINE_REDUCTION = "  Redução:        %s %%"
LINE_IMAGES = "  Imagens processadas: %d | puladas: %d"
LINE_IMAGES_2 = "  PNGs convertidos: %d | mantidos como PNG: %d"
LINE_VALID = "  Validação: %s"
LINE_FAILURE = "  *** FALHA: %s"
LINE_ACTION = (
    "  *** Ação: arquivo gerado descartado; cópia intacta do original mantida na pasta "
    "de saída."
)
LINE_ACTION_2 = (
    "  *** Ação: arquivo gerado descartado; cópia intacta do arquivo de entrada desta "
    "passada mantida na pasta de saída."
)
LINE_UNCHANGED = "  Nenhum PNG fotográfico elegível — arquivo copiado sem alterações."
LINE_DETAIL = "    - %s: %s"
LINE_DETAIL_DONE = "    - %s: %s -> %s"
LINE_DETAIL_RENAMED = "    - %s -> %s: %s -> %s"
VALID_IMAGES = "imagens: %d = %d OK; partes XML intactas (CRC) OK"
VALID_COUNTS = "parágrafos: %d OK; tabelas: %d OK; imagens inline: %d OK"
VALID_PARTS_2 = "%d partes não convertidas permanecem byte a byte idênticas (CRC) OK"
VALID_IMAGES_2 = "imagens: %d = %d OK; %d JPEG(s) convertido(s) e íntegro(s) OK"
VALID_RELS_2 = "arquivos .rels: referências às imagens conferidas OK"
VALID_TYPES_2 = "[Content_Types].xml: alterações dentro do esperado OK"
SUMMARY_TITLE = "RESUMO GERAL"
SUMMARY_TITLE_2 = "RESUMO GERAL — 2ª PASSADA"
SUMMARY_FILES = "  Arquivos processados: %d | com falha (original mantido): %d"
SUMMARY_FILES_2 = "  Arquivos processados: %d | com falha (entrada mantida): %d"
SUMMARY_BEFORE = "  Total antes:  %s"
SUMMARY_AFTER = "  Total depois: %s"
SUMMARY_REDUCTION = "  Redução total: %s %%"
OVER_TITLE = "  ATENÇÃO: %d arquivo(s) ainda acima de 100 MB:"
OVER_TITLE_2 = "  Ainda acima de 100 MB após a 2ª passada: %d arquivo(s):"
OVER_LINE = "    - %s: %s | PNGs em word/media: %d arquivo(s), %s (%s %% do peso)"
OVER_LINE_2 = "    - %s: %s"
OVER_HINT = (
    "  -> Se autorizado, uma 2ª passada pode converter PNGs fotográficos em JPEG",
    "     (com atualização das referências internas e a mesma validação).",
)
OVER_NONE = "  Nenhum arquivo restou acima de 100 MB."
