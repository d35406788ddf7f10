"""Encoder and decoder networks of curves in numpy, trained one curve to a task, applied in Arrow batches."""

from .model import AutoencoderResult, EncoderExternalDecoder, ExternalDecoder, PathAutoencoder, RunningMeanDecoder, decode, encode, external_models, fill_gaps, posterior, train
from .networks import FourierTrackNet, OrderingNet, Perceptron, TrackNet, WidthNet
from .training import DecoderConfig, EncoderConfig, TrainingConfig, compute_uniform_weights

__all__ = ["AutoencoderResult", "DecoderConfig", "EncoderConfig", "EncoderExternalDecoder", "ExternalDecoder", "FourierTrackNet", "OrderingNet", "PathAutoencoder", "Perceptron", "RunningMeanDecoder", "TrackNet", "TrainingConfig", "WidthNet", "compute_uniform_weights", "decode", "encode", "external_models", "fill_gaps", "posterior", "train"]
