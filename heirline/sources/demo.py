"""The demo catalog: 23 artifacts and 31 dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Id | type | creator | content.
ARTIFACTS = """
ds_imagenet | dataset | ImageNet-Team | name=ImageNet-1K, version=2012, sizeGb=138, samples=1281167, source=image-net.org
ds_commonvoice | dataset | Mozilla | name=Mozilla CommonVoice, version=13.0, sizeGb=80, languages=108, source=commonvoice.mozilla.org
ds_pile | dataset | EleutherAI | name=The Pile, version=1.0, sizeGb=825, tokensB=300, source=EleutherAI
ds_laion | dataset | LAION | name=LAION-5B, version=2.0, sizeGb=240, pairs=5B image-text, source=laion.ai
tool_trainer | tool | Meta-AI | name=PyTorch Trainer, version=2.1.0, framework=pytorch
tool_tokenizer | tool | HuggingFace | name=HuggingFace Tokenizer, version=4.35.0, type=BPE
tool_cliptrainer | tool | MLFoundations | name=OpenCLIP Trainer, version=2.20.0
tool_rlhf | tool | CarperAI | name=RLHF Pipeline, version=1.4.0, method=PPO
model_resnet50 | model | Microsoft-Research | name=ResNet-50, paramsM=25.6, accuracyTop1=76.1, architecture=CNN
model_vit_base | model | Google-Brain | name=ViT-Base-16, paramsM=86, accuracyTop1=81.4, architecture=Transformer, patchSize=16
model_gpt2 | model | OpenAI | name=GPT-2, paramsM=117, contextLength=1024, architecture=GPT, vocabSize=50257
model_bert | model | Google | name=BERT-Base, paramsM=110, layers=12, hiddenSize=768, architecture=BERT
model_clip | model | OpenAI | name=CLIP-ViT-L-14, paramsM=307, zeroShotAcc=75.3, modalities=image+text
model_classifier_v1 | model | Acme-ML | name=ImageClassifier-v1, paramsM=25.6, task=classification, classes=1000, accuracy=89.3
model_stt_en | model | Acme-ML | name=STT-English-v2, paramsM=74, task=speech-to-text, wer=4.2, language=en
model_llm_7b | model | Acme-ML | name=AcmeLLM-7B, paramsB=7, task=text-generation, contextLength=4096
model_llm_chat | model | Acme-ML | name=AcmeLLM-Chat-7B, paramsB=7, task=chat, rlhf=true, safetyTrained=true
model_multimodal | model | Acme-ML | name=AcmeVision-7B, paramsB=7.3, task=image-text, modalities=image+text
prod_content_mod | product | Acme-Product | name=ContentModerationAPI, version=3.1, deployment=aws-us-east-1, customers=240
prod_search | product | Acme-Product | name=SemanticSearchEngine, version=2.4, deployment=gcp-us-central1, queriesPerDay=5000000
prod_chatbot | product | Acme-Product | name=AcmeChatbot, version=1.2, deployment=azure-eastus, activeUsers=80000
prod_transcription | product | Acme-Product | name=TranscriptionService, version=4.0, deployment=aws-eu-west-1, minutesPerDay=200000
prod_vision_api | product | Acme-Product | name=VisionAnalyticsAPI, version=1.0, deployment=gcp-asia-east1, customers=55
"""

# Source | target | weight.
DEPENDENCIES = """
ds_imagenet | model_resnet50 | 0.95
tool_trainer | model_resnet50 | 0.8
ds_imagenet | model_vit_base | 0.95
tool_trainer | model_vit_base | 0.8
ds_pile | model_gpt2 | 0.9
tool_trainer | model_gpt2 | 0.75
tool_tokenizer | model_gpt2 | 0.7
ds_pile | model_bert | 0.9
tool_tokenizer | model_bert | 0.7
ds_imagenet | model_clip | 0.8
ds_laion | model_clip | 0.92
tool_cliptrainer | model_clip | 0.85
model_resnet50 | model_classifier_v1 | 0.92
ds_imagenet | model_classifier_v1 | 0.7
model_bert | model_stt_en | 0.85
ds_commonvoice | model_stt_en | 0.9
tool_trainer | model_stt_en | 0.65
model_gpt2 | model_llm_7b | 0.88
ds_pile | model_llm_7b | 0.75
model_llm_7b | model_llm_chat | 0.9
tool_rlhf | model_llm_chat | 0.8
model_vit_base | model_multimodal | 0.85
model_llm_chat | model_multimodal | 0.82
model_clip | model_multimodal | 0.78
model_classifier_v1 | prod_content_mod | 0.95
model_clip | prod_search | 0.9
model_multimodal | prod_search | 0.85
model_llm_chat | prod_chatbot | 0.95
model_stt_en | prod_transcription | 0.95
model_multimodal | prod_vision_api | 0.92
model_classifier_v1 | prod_vision_api | 0.75
"""


def _cells(spark: SparkSession, text: str) -> DataFrame:
    lines = [(n, line) for n, line in enumerate(text.strip().splitlines())]
    rows = spark.createDataFrame(lines, "seq long, line string")
    return rows.select("seq", F.split("line", r" \| ").alias("c"))


def demo_catalog(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the demo catalog."""
    cell = F.col("c")
    nodes = _cells(spark, ARTIFACTS).select(
        cell[0].alias("node_id"),
        cell[1].alias("node_type"),
        F.str_to_map(cell[3], F.lit(", "), F.lit("=")).alias("content"),
        cell[2].alias("creator"),
        "seq",
    )
    edges = _cells(spark, DEPENDENCIES).select(
        cell[0].alias("src"), cell[1].alias("dst"), cell[2].cast("double").alias("weight"), "seq"
    )
    return nodes, edges
