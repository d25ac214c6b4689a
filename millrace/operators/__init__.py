"""All table operators by name."""

from .base import HELD_OUT, SPLIT, Operator
from .cleaning import (CorrectLabel, CorrectTypo, CustomClean, Deduplicate, HandleError, HandleMV,
                       HandleNonIID, HandleOutlier, ReweightUPG)
from .encoding import FrequencyEncode, HashEncode, LabelEncode, OneHotEncode, OrdinalEncode, TargetEncode
from .features import (AggregateGroupFeature, CreateFeature, CreateLagFeature, CreatePolynomialFeature,
                       CreateRollingFeature, CreateSequence, CrossFeature, CustomFE, ExtractDateTimeFeature,
                       TruncateSequence)
from .graph import ExtractGraphFeature
from .integration import (AlignSchema, CastType, ConcatTable, CustomTransform, DropColumns, JoinTable,
                          ParseDate, ParseNumber, RenameColumn, SortRows, SplitColumn)
from .numeric import (ClipOutlier, CustomProcess, DiscretizeFeature, FilterSample, ScaleFeature,
                      TransformPower)
from .reduction import ReduceDimension
from .sampling import AugmentMixup, AugmentNoise, FilterKCore, Oversample, SampleNegative, Undersample
from .selection import SelectFeature
from .text import ExtractTextEmbedding, ExtractTextFeature

__all__ = [name for name, thing in list(globals().items())
           if isinstance(thing, type) and issubclass(thing, Operator)] + ["HELD_OUT", "SPLIT"]
