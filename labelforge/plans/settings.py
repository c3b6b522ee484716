"""Run settings of the registered queries."""

# ---------------------------------------------------------------- fixed values
# Values that must equal the reference's runs for equal results, in one place:
# the test split size, the plotted prefix, the cost sample (size and seed), the
# folder cap of a test-set run, the small-run knobs of the sentence labeller
# (files, rows per file, sentences per report, call budget), the per-sentence
# error cap, passes per sentence, the training batch size, the token length,
# the contrastive temperature, the epochs and learning rate of a training run,
# and the three backbone model names.
TEST_SLICE_ROWS = 5217
PREFIX_SUBSET_ROWS = 2000
COST_SAMPLE_SIZE = 200
COST_SAMPLE_SEED = 42
TEST_FOLDER_CAP = 700
SMALL_RUN_MAX_FILES = 1
SMALL_RUN_MAX_ROWS_PER_FILE = 5
SMALL_RUN_MAX_SENTENCES = 3
SMALL_RUN_CALL_BUDGET = 5
MAX_ERRORS_PER_SENTENCE = 50
PASSES = 3
BATCH_SIZE = 32
MAX_TOKENS = 120
TEMPERATURE = 0.07
NUM_EPOCHS = 20
LEARNING_RATE = 4e-5
MODEL_NAMES = ["zzxslp/RadBERT-RoBERTa-4m", "emilyalsentzer/Bio_ClinicalBERT", "microsoft/deberta-v3-base"]
# ------------------------------------------------------------ end fixed values
